"""What can go wrong, by kind."""


class WorkbenchError(Exception):
    """Base of all errors of this package."""


class InvalidInput(WorkbenchError, ValueError):
    """A parameter, pattern, column or document that can't be used."""


class DataSourceError(WorkbenchError):
    """A file that can't be read as its format says."""


class ProcessorError(WorkbenchError):
    """A rule or an operation that can't be carried out."""


class Unsupported(WorkbenchError, NotImplementedError):
    """A format or statement that isn't supported."""


class DependencyMissing(WorkbenchError):
    """An outside program that a source needs isn't there."""


class Conflict(WorkbenchError):
    """Another session has changed a sheet in the meantime."""
