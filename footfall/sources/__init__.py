"""Reading and writing with declared schemas."""
