"""jobsift: job-posting ingest, classification, dedup, skill extraction and
CV-to-job matching as Spark DataFrame jobs.

Public surface: ``jobsift.<package>.<module>.<op>(df, ...) -> DataFrame``.
"""

__version__ = "0.1.0"
