"""lexweave: entity linking and corpus analytics as PySpark DataFrame jobs."""
