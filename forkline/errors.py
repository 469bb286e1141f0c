"""Errors of the engine, each with a fixed code."""


class EngineError(Exception):
    code = "INTERNAL_ERROR"

    def __init__(self, message: str = ""):
        super().__init__(f"{self.code}: {message}" if message else self.code)
        self.message = message


class NotFound(EngineError):
    """A thing that was asked for does not exist."""


class ProjectNotFound(NotFound):
    code = "PROJECT_NOT_FOUND"


class BranchNotFound(NotFound):
    code = "BRANCH_NOT_FOUND"


class ObjectNotFound(NotFound):
    code = "OBJECT_NOT_FOUND"


class SnapshotNotFound(NotFound):
    code = "SNAPSHOT_NOT_FOUND"


class ProjectAlreadyExists(EngineError):
    code = "PROJECT_ALREADY_EXISTS"


class BranchHasChildren(EngineError):
    code = "BRANCH_HAS_CHILDREN"


class Conflict(EngineError):
    code = "CONFLICT"


class BranchIsRoot(EngineError):
    code = "BRANCH_IS_ROOT"


class InvalidCursor(EngineError):
    code = "INVALID_CURSOR"


class InvalidInput(EngineError):
    code = "INVALID_INPUT"


class InvalidRestoreLsn(EngineError):
    code = "INVALID_RESTORE_LSN"


class StorageError(EngineError):
    code = "STORAGE_ERROR"


class ChunkStoreError(EngineError):
    code = "CHUNK_STORE_ERROR"
