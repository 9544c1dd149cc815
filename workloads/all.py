"""Import every workload module so that its queries register."""

from workloads import contracts, files, ingest, panel, scores, series, stats, timeline  # noqa: F401
