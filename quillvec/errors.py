"""Errors of the engine. Wrong shapes and arguments are plain ``ValueError``."""


class EngineError(Exception):
    """Root of the engine's own errors."""


class IndexOperationError(EngineError):
    """An operation on an index can't be carried out."""


class IndexConfigError(IndexOperationError):
    """An index was described or stored wrongly."""


class DuplicateIDError(IndexOperationError):
    def __init__(self, chunk_id: str):
        super().__init__(f"id already present: {chunk_id}")
        self.chunk_id = chunk_id


class IDNotFoundError(IndexOperationError):
    def __init__(self, chunk_id: str):
        super().__init__(f"no such id: {chunk_id}")
        self.chunk_id = chunk_id


class IngestError(EngineError):
    """Records can't be taken in."""


class DatasetFormatError(IngestError):
    """A data set's file can't be read as what it claims to be."""


class ChunkingError(IngestError):
    """A file can't be chunked."""


class ServiceError(EngineError):
    """A request can't be served."""


class QueryError(EngineError):
    """A query is malformed."""


class EmbeddingError(EngineError):
    """An embedder failed or is missing."""
