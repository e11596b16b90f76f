"""Errors raised while a pipeline is being built (and by failing runs)."""

from __future__ import annotations


class PipelineError(Exception):
    """Base of all pipeline errors."""


class StreamAlreadyExists(PipelineError): ...


class StreamNotFound(PipelineError): ...


class InputAlreadyDerived(PipelineError): ...


class UnexpectedNumberOfStreams(PipelineError): ...


class FieldNotFound(PipelineError): ...


class InvalidFieldName(PipelineError): ...


class InvalidFieldType(PipelineError): ...


class FieldAlreadyExistsInStream(PipelineError): ...


class FieldNotFoundInStream(PipelineError): ...


class InvalidTokenStream(PipelineError):
    """A body or graph text that can't be parsed."""


class ExpectedMinimalOrder(PipelineError):
    """An operator needs its input in an order that the stream's facts don't give."""


class ExpectedDistinct(PipelineError):
    """An operator needs fields to be distinct and the stream's facts don't say so."""


class ParseParams(PipelineError): ...


class Other(PipelineError): ...
