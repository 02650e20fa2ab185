"""The one exception type that callers are expected to show to users."""


class ReconcileInputError(ValueError):
    """An input, column, key or option that a check cannot work with."""
