"""lexiloom: a PySpark-native analytics engine for document corpora and bilingual text."""
