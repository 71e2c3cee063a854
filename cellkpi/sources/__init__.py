"""Extract readers, fact table readers and writers, and test views."""
