"""vulnlake: a PySpark-native analytics engine for vulnerability intelligence."""
