"""loomspark: a PySpark-native analytics engine over a typed deck / event / card graph."""
