"""Drawing takeoff, pricing and reconciliation as set-oriented Spark jobs."""
