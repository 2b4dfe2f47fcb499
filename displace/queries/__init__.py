"""All registered queries, by area."""

from displace.queries import aggregates, filters, ingest, joins, raster, scalars, series, sinks, sites  # noqa: F401
