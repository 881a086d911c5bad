"""A PySpark-native engine for long financial documents, their figures and the text around them."""
