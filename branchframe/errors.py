"""Errors that callers tell apart by kind. Messages never hold keys, values or names of data."""

from __future__ import annotations

import functools
import inspect
import secrets
import threading
from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException


class EngineError(Exception):
    """Base of all; ``kind`` names what happened."""

    kind = "Internal"


def _kind(name: str) -> type[EngineError]:
    return type(f"{name}Error", (EngineError,), {"kind": name})


PermissionDeniedError = _kind("PermissionDenied")
SerializationError = _kind("Serialization")
NotFoundError = _kind("NotFound")
ExistsError = _kind("Exists")
WrongKindError = _kind("WrongKind")
InvalidError = _kind("Invalid")
MergeInProgressError = _kind("MergeInProgress")
ClosedError = _kind("Closed")
SessionLostError = _kind("SessionLost")
InUseError = _kind("InUse")
InternalError = _kind("Internal")
CancelledError = _kind("Cancelled")

Logger = Callable[[str, str], None]


def scrub(error: BaseException, log: Logger | None = None) -> EngineError:
    """An error that tells its kind and a correlation id only; the detail goes to the log, once."""
    if getattr(error, "scrubbed", False):
        return error  # type: ignore[return-value]
    code = secrets.token_hex(8)
    if log is not None:
        log(code, f"{type(error).__name__}: {error}")
    kind = type(error) if isinstance(error, EngineError) else InternalError
    out = kind(f"{kind.kind} ({code})")
    out.scrubbed = True  # type: ignore[attr-defined]
    return out


_depth = threading.local()


def guarded(log_of: Callable[[object], Logger | None]) -> Callable[[type], type]:
    """A class whose public methods let errors out only as a kind and a code: those of the engine, and Spark's, which may quote data.

    The outermost call of a thread does it, once, so that callers within the engine see whole errors. A DataFrame that is
    returned runs outside of it.
    """

    def wrap(method: Callable) -> Callable:
        @functools.wraps(method)
        def call(self, *args, **kwargs):
            outermost = not getattr(_depth, "inside", False)
            _depth.inside = True
            try:
                return method(self, *args, **kwargs)
            except (EngineError, PySparkException, Py4JError) as error:
                if not outermost:
                    raise
                raise scrub(error, log_of(self)) from None
            finally:
                if outermost:
                    _depth.inside = False

        return call

    def decorate(cls: type) -> type:
        for name, method in list(vars(cls).items()):
            if not name.startswith("_") and inspect.isfunction(method):
                setattr(cls, name, wrap(method))
        return cls

    return decorate
