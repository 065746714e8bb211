"""Market-signal analytics as Spark jobs: anomaly scans, signal joins, driver
attribution, finding validation, evaluation and the company-signal graph."""
