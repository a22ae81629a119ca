"""Spark-native collection, classification, versioning and roll-up of public notices."""
