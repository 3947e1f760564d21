"""waybill - parcel-logistics analytics as Spark DataFrame plans.

Every public function maps DataFrames (or Columns) to DataFrames (or
Columns); nothing here runs a Spark action, collects rows or uses a Python
UDF.  The packages are:

* ``functions`` - Column helpers: clocks, calendars, classifiers, fixed values
* ``sources``   - scans: snapshots, latest versions, calendars, id lists
* ``operators`` - DataFrame operators: milestones, attempts, lookups, KPIs
* ``plans``     - the reports, composed from the operators
"""

__version__ = "0.1.0"
