"""The catalogue of named queries; importing this package fills it."""

from seqloom.plans import breadth, catalogue, fields, live, models, records, shapes, voices  # noqa: F401
