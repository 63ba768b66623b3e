"""tillroll: receipt and document analytics as composable PySpark DataFrame operators."""
