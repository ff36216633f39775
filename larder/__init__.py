"""larder: bulk intake, audits and operational analytics as PySpark DataFrame operators."""
