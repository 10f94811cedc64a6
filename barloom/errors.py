"""The kinds of failure that a run reports."""


class TradingError(Exception):
    """A failure of the domain; the others are its kinds."""


class ValidationError(TradingError, ValueError):
    """An input or a precondition does not hold."""


class DataError(TradingError):
    """Data from outside is missing or malformed."""


class ComputeError(TradingError):
    """A number or a model could not be computed."""


class ExecutionError(TradingError):
    """An order could not be executed."""


class BrokerError(TradingError):
    """A broker's table or answer failed."""
