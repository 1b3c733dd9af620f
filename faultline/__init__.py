"""Asset-fault analytics on Spark: telemetry in, verified maintenance decisions out."""
