"""Column functions; all stay in the JVM but those named ``*_bytes``."""
