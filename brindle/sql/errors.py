class EngineError(Exception):
    """A statement that can't be run; the message says why."""
