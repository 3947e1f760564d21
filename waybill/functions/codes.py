"""Fixed values.

Everything in this file is data that has to be equal to what the marts hold
(event codes, state codes, labels, calendar days); there is no logic here.
"""

from __future__ import annotations

# --- fixed values: tracking event codes -----------------------------------
RECEIVED = ("F000",)
PICKUP_DONE = ("F100", "F510")
PICKUP_DONE_EXPRESS = ("F100", "F510", "F420")
PICKUP_DONE_WIDE = ("F100", "F510", "F420", "F450")
PICKUP_FIRST = ("F001", "F002", "F100", "F510", "F050", "F097", "F098")
PICKUP_FIRST_EXPRESS = ("F001", "F002", "F100", "F510", "F420", "F050", "F097")
PICKUP_ATTEMPT = ("F001",)
PICKUP_FAILED = ("F097",)
HUB_INBOUND = ("F599",)
DELIVERING = ("F600",)
DELIVERY_PENDING = ("F650",)
DELIVERY_FIRST = ("F600", "F650", "F980", "F668", "F680")
DELIVERY_FIRST_WIDE = ("F600", "F650", "F980", "F668", "F680", "F999")
DELIVERED = ("F980",)
RETURN_STARTED = ("F668",)
RETURN_STARTED_WIDE = ("F668", "F680")
RETURN_PENDING = ("F699",)
RETURNED = ("F999",)
RETURNED_WIDE = ("F999", "F998")
RETURN_FIRST = ("F699", "F999", "F998")

# --- fixed values: numeric statuses of the older tracking log --------------
LEGACY_RECEIVED = (1,)
LEGACY_PICKUP_FIRST = (26, 2, 8, 9)
LEGACY_PICKUP_DONE = (2, 8, 9)
LEGACY_DELIVERED = (11,)
LEGACY_RETURN = (18, 22)
LEGACY_FAILED = (12, 19, 20)
LEGACY_PENDING = (13,)

# --- fixed values: resource statuses of the tracking log -------------------
RESOURCE_PICKUP_FAILED = ("21",)
RESOURCE_PICKUP_DONE = ("19", "20")
RESOURCE_RETURN = ("25",)

# --- fixed values: order audit statuses -----------------------------------
AUDIT_PICKUP_DONE = 2
AUDIT_DELIVERED = 5
AUDIT_DELIVERY_FAILED = 6

# --- fixed values: order logistics states ----------------------------------
ORDER_STATES = {
    0: "LOGISTICS_NOT_STARTED",
    1: "LOGISTICS_REQUEST_CREATED",
    2: "LOGISTICS_PICKUP_DONE",
    3: "LOGISTICS_PICKUP_RETRY",
    4: "LOGISTICS_PICKUP_FAILED",
    5: "LOGISTICS_DELIVERY_DONE",
    6: "LOGISTICS_DELIVERY_FAILED",
    7: "LOGISTICS_REQUEST_CANCELED",
    8: "LOGISTICS_COD_REJECTED",
    9: "LOGISTICS_READY",
    10: "LOGISTICS_INVALID",
    11: "LOGISTICS_LOST",
    12: "LOGISTICS_PENDING_ARRANGE",
}

# --- fixed values: parcel states, label -> codes ---------------------------
PARCEL_STATES = {
    "NEW": (1000,),
    "INFO_RECEIVED": (1001, 1040),
    "IN_TRANSIT": (1061, 1051, 2001, 2008, 2009, 2015, 2030, 2040, 3001, 3060, 3080, 3090),
    "EXCEPTION": (9997, 3099, 3070),
    "CANCELLED": (9999,),
    "DOMESTIC_PICKUP": (1050,),
    "DOMESTIC_SORTING": (4010, 4020, 4100),
    "DOMESTIC_DELIVERING": (4060,),
    "DOMESTIC_DELIVERED": (4097,),
    "DELIVERY_PENDING": (4070,),
    "PARCEL_LOST": (9998,),
    "PARCEL_RETURN": (8020,),
    "RETURN_COMPLETED": (8050,),
    "RETURN_FAILED": (8099,),
    "PENDING_FOR_RETURN": (8045,),
    "REQUEST_RETURN": (4098, 8001, 4102),
    "PICKUP_RETRY": (996, 1041, 8010),
    "DOMESTIC_PICKUP_FAILED": (1099, 2099, 9995),
    "DOMESTIC_DROPOFF": (1060,),
    "DOMESTIC_PICKUP_PENDING": (1042,),
    "RETURN_STARTED": (8000, 8040),
    "UPDATE_STORE_SUBMITTED": (4101,),
    "UPDATE_STORE_CANCEL": (4103,),
    "IMLM_DISPOSED": (9994,),
    "PARCEL_CONFISCATED": (8060,),
    "TERMINATE_AS_DAMAGE": (9993,),
}
PARCEL_STATE_UNKNOWN = "no"

# --- fixed values: carrier labels by channel id ----------------------------
CARRIER_BY_CHANNEL = {
    50022: "Shopee Express Instant",
    50020: "GrabExpress",
    50026: "beDelivery",
    5000: "Hỏa Tốc",
    50024: "BEST Express",
    50021: "Shopee Express",
    5001: "Nhanh",
    50018: "J&T Express",
    50025: "Đợi phân bổ ĐVVC",
    50010: "Viettel Post",
    50012: "Giao Hàng Tiết Kiệm",
    50015: "VNPost Nhanh",
    50023: "Ninja Van",
    50016: "VNPost Tiết Kiệm",
    5002: "Tiết kiệm",
}
# (channel, shipping method) -> label
CARRIER_BY_METHOD = {
    (50011, 5001): "Giao Hàng Nhanh",
    (50011, 5002): "Giao Hàng Nhanh - ECO",
}
# The weekly area report uses a shorter list and splits one more channel.
AREA_CARRIER_BY_CHANNEL = {
    50024: "BEST Express",
    50021: "Shopee Express",
    50018: "J&T Express",
    50010: "Viettel Post",
    50012: "Giao Hàng Tiết Kiệm",
    50015: "VNPost Nhanh",
    50016: "VNPost Tiết Kiệm",
    5002: "Tiết kiệm",
}
AREA_CARRIER_BY_METHOD = {
    (50011, 5001): "Giao Hàng Nhanh",
    (50011, 5002): "Giao Hàng Nhanh - ECO",
    (50023, 5001): "Ninja Van",
    (50023, 5002): "Ninja Van - ECO",
}
EXPRESS_CHANNEL = 50015
ECONOMY_CHANNEL = 50016
EXPRESS_CARRIER = "VNPost Nhanh"
ECONOMY_CARRIER = "VNPost Tiết Kiệm"
CROSS_BORDER_CARRIER_LIKE = "%Standard Express%"
CROSS_BORDER_SPX_LIKE = "%SPX%"
CROSS_BORDER_JNT_PATTERN = "JNT|J&T"
CROSS_BORDER_SPX_LABEL = "Shopee Express - CB"
CROSS_BORDER_JNT_LABEL = "J&T Express - CB"

# --- fixed values: cross-border provider ids -------------------------------
PROVIDERS_NORTH = ("VN_JNT", "VN_J&T_N_Standard", "VN_CB_SPX_N", "CB_VN_SPX_N")
PROVIDERS_SOUTH = ("VN_JNT_S", "VN_J&T_S_Standard", "VN_CB_SPX_S", "CB_VN_SPX_S")
PROVIDERS_JNT = ("VN_JNT", "VN_J&T_N_Standard", "VN_JNT_S", "VN_J&T_S_Standard")
PROVIDERS_SPX = (
    "VN_CB_SPX_N", "CB_VN_SPX_N", "VN_CB_SPX_S", "CB_VN_SPX_S",
    "VNR_ID_SPX_SIP_N", "VNR_ID_SPX_SIP_S",
)
WAREHOUSES_NORTH = ("VNN",)
WAREHOUSES_SOUTH = ("VNS", "VNW")
HUB_NORTH = ("Hà Nội", "Quận Long Biên")
HUB_SOUTH = ("TP. Hồ Chí Minh", "Huyện Củ Chi")
TPL_NAME_JNT, TPL_NAME_SPX = "J&T Express", "Shopee Express"
TPL_CALL_JNT, TPL_CALL_SPX = "J&T - CB", "SPX - CB"
TPL_CALL_CHANNEL = {50021: "Shopee Xpress"}
UNALLOCATED_CHANNELS = (50025, 50028, 50029)
MIDNIGHT_DUE_CHANNEL = 50024

# --- fixed values: service-level column by channel -------------------------
# (which channel id is looked at, channel, service-level column, add-on too)
SLA_COLUMNS = (
    ("client", 50015, "sla_vnp_ex", True),
    ("client", 50016, "sla_vnp_eco", True),
    ("client", 50021, "spx", False),
    ("client", 50011, "ghn", False),
    ("order", 50023, "njv", False),
    ("client", 50024, "best", False),
    ("order", 50018, "jnt", False),
)
SLA_AREA_CHANNEL = 50010
SLA_CUTOFF_CHANNEL = 50012
AREA_URBAN, AREA_RURAL, AREA_HARD = "Urban", "Rural", "Hard to delivery zone"

# --- fixed values: pickup incident, channels, hubs -------------------------
INCIDENT_NOTE = "Nhân viên gặp sự cố"
INTERNAL_CHANNEL = "WH - Shopee"
PICKUP_CLIENT_ID = 18692
OPEN_PICKUP_STATUSES = ("ready_to_pick", "picking")
KEY_ACCOUNT_WAREHOUSES = (1297, 1327)
INSTANT_HUB_LIKE = "%Ahamove%"
POST_OFFICE_LIKE = "bưu cục%"
TRANSIT_WAREHOUSE_LIKE = "%Kho Chuyển Tiếp %"
FREIGHT_DEPARTMENT = "Freight Operations Department"
HUB_INSTANT, HUB_KEY_ACCOUNT, HUB_TRANSIT, HUB_POST = "Ahamove", "KHL", "GXT", "BC"
HUB_REGIONAL, HUB_KEY_OR_TRANSIT = "Vùng", "KHL/GXT"
SOUTH_PROVINCE = "Hồ Chí Minh"
WAREHOUSE_SOUTH = "Key Account Warehouse Ho Chi Minh"
WAREHOUSE_NORTH = "Key Account Warehouse Ha Noi"

# --- fixed values: failure reasons that are the customer's -----------------
CUSTOMER_FAULT = "tu choi|thay doi dia chi phat|khong tim thay|sai"

# --- fixed values: labels of the attempt checks ----------------------------
GAP_TWICE_15_MIN = "Gọi 2 lần trong vòng 15 phút"
GAP_MORNING_AFTERNOON = "2 ca sáng chiều"
GAP_INVALID = "Không hợp lệ"
GAP_VALID = "Hợp lệ"
HOUR_ABNORMAL, HOUR_NORMAL = "Bất thường", "Bình thường"
HOUR_LATE, HOUR_EARLY = "Sau 21h", "Trước 6h"

# --- fixed values: labels of the delivery checks ---------------------------
ON_TIME_LABEL, LATE_LABEL = "Giao đúng hẹn", "Trễ giao"
STATE_RETURNED, STATE_DELIVERED, STATE_OPEN = (
    "Phát hoàn thành công", "Đơn giao thành công", "Đơn tồn giao")
FIRST_ON_TIME, FIRST_LATE = "Liên hệ lần đầu đúng hẹn", "Liên hệ lần đầu trễ"
FIRST_TRY_OK, FIRST_TRY_NOT_OK = "Giao thành công lần đầu", "Giao không thành công lần đầu"
RETURN_OK, RETURN_NONE = "Hoàn thành công", "Đơn không hoàn"
DELIVERY_OK, DELIVERY_NOT_OK = "Giao thành công", "Không giao thành công"

# --- fixed values: penalty labels ------------------------------------------
PICKUP_LATE = "50% trễ lấy-"
DELIVERY_LATE = "50% trễ giao-"
RETURN_LATE = "50% trễ hoàn-"
DELIVERY_LATE_OVERALL = "100% trễ giao-"
RETURN_LATE_OVERALL = "100% trễ hoàn-"
ECONOMY_OVERALL_DAYS, EXPRESS_OVERALL_DAYS = 15, 11
WEEKEND_DIVISOR = 7.1
FAILED_OR_LOST = ("CANCEL_REASON_LOGISTICS_DELIVERY_FAILED", "CANCEL_REASON_LOST_PARCEL")

# --- fixed values: fees ------------------------------------------------------
FEE_FREE_CHANNELS = (51000, 50020, 50021)
FEE_RATES = ((None, 0.022), ("2022-04-01", 0.025))  # (valid from, rate)

# --- fixed values: totals row labels ----------------------------------------
TOTAL_LABEL = "Nationwide Total"
WEEKLY_TOTAL_LABEL = "XXX_Total"
