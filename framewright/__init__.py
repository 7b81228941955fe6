"""Framewright: a Spark-first data plane for episodic robot-learning data."""
