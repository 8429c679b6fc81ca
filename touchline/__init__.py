"""Match-tracking analytics for Spark: DataFrame operators over per-frame detections, tracks and pass events."""
