"""The one exception type callers need to catch."""


class TableError(ValueError):
    """A table, a configuration or a step cannot be processed as asked."""
