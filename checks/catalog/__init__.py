"""All registered queries; importing this package fills the registry."""

from . import primitives, joins_aggs, scalars, domain, pickup, reports  # noqa: F401
