"""textloom: text forensics and corpus analytics as Spark DataFrame operators."""
