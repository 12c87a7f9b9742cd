"""fakturnik: a PySpark-native engine that turns business paperwork into tables."""
