"""Errors that users meet."""


class DatalogError(Exception):
    """Anything wrong with a program, its facts or a change."""


class ParseError(DatalogError):
    """The text is no program; says line and column."""


class AnalysisError(DatalogError):
    """The program has no meaning: arity, types, unbound variables, stratification."""


class FixpointError(DatalogError):
    """A recursion did not settle within the allowed rounds."""


class SessionError(DatalogError):
    """A change that a session can't take."""
