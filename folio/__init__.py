"""folio: paper intake, lifecycle and TEI structuring as Spark jobs.

Layout
------
functions/  column expressions (text, XML normalisation, hashing)
operators/  DataFrame -> DataFrame operators (intake, lifecycle, TEI, engines)
sources/    scans and sinks (binaryFile uploads, TEI tables, papers store)
plans/      composed jobs (submit, process) and the driver query set
streaming/  Structured Streaming versions of intake, parse and status
"""

__version__ = "0.1.0"
