"""Phase-topology, signal, evidence and text analytics as Spark DataFrame jobs."""
