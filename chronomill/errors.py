"""Errors and warnings of the stream engine."""


class EngineError(Exception):
    """Base of all errors raised here."""


class StreamNotFound(EngineError):
    """No stream has the id asked for."""


class MultipleStreamsReturned(EngineError):
    """A query that must name one stream matches several."""


class InconsistentStreamConfiguration(EngineError):
    """An existing stream differs in something that cannot change."""


class OutstandingDependenciesError(EngineError):
    """A stream cannot go while another is derived from it."""


class LockExpiredMidMaintenance(EngineError):
    """A maintenance run lost its claim on the store."""


class StreamAppendContended(EngineError):
    """Another writer appended to the stream meanwhile."""


class StreamAppendFailed(EngineError):
    """A batch could not be written."""


class UnsupportedDownsampler(EngineError, ValueError):
    """A downsampler is unknown, or not defined for the stream's type."""


class UnsupportedGranularity(EngineError, ValueError):
    """Not one of the levels."""


class UnsupportedDeriveOperator(EngineError, ValueError):
    """Not one of the derive operators."""


class ReservedTagNameError(EngineError, ValueError):
    """A tag has a name that the engine keeps for itself."""


class InvalidTimestamp(EngineError, ValueError):
    """A timestamp is out of range or out of order."""


class IncompatibleGranularities(EngineError, ValueError):
    """A source cannot serve the level asked of it."""


class AppendToDerivedStreamNotAllowed(EngineError, ValueError):
    """Derived streams take no datapoints."""


class InvalidOperatorArguments(EngineError, ValueError):
    """A derive operator got the wrong sources or arguments."""


class UnsupportedValueType(EngineError, TypeError):
    """Not one of the value types."""


class IncompatibleTypes(EngineError, TypeError):
    """A derive operator cannot work with a stream of this type."""


class EngineWarning(RuntimeWarning):
    """Base of all warnings."""


class InvalidValueWarning(EngineWarning):
    """A stored value was skipped."""


class InternalInconsistencyWarning(EngineWarning):
    """Stored aggregates contradict each other."""


class DownsampleConsistencyNotGuaranteed(EngineWarning):
    """Rollups may miss datapoints that came late."""
