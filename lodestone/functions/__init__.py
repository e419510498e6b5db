"""Column builders: text, identifiers, classes and scores. All stay inside the JVM."""
