"""Retention engine on PySpark: expire, archive, purge, restore, verify, reconcile."""

from coldkeep.model import (
    ArchiveCheckFailed,
    ArchiveIncomplete,
    KeyAuditFailed,
    LifecyclePolicy,
    NoArchiveFiles,
    RestoreConflict,
    RetentionError,
    Rule,
    RunExists,
    SchemaMismatch,
    Selection,
    TableRule,
    UnknownTable,
)

__all__ = [
    "ArchiveCheckFailed",
    "ArchiveIncomplete",
    "KeyAuditFailed",
    "LifecyclePolicy",
    "NoArchiveFiles",
    "RestoreConflict",
    "RetentionError",
    "Rule",
    "RunExists",
    "SchemaMismatch",
    "Selection",
    "TableRule",
    "UnknownTable",
]
