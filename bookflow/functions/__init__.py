from . import text, times  # noqa: F401
