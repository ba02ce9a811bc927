"""quirespark: document-structure analytics as ordinary Spark DataFrame operators."""
