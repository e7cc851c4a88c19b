"""tallyline: a governed order-line engine expressed as Spark DataFrame jobs."""
