"""Column layouts and fixed vocabularies."""

from __future__ import annotations

from pyspark.sql import types as T

_PROPERTIES = [
    "image_path", "parent_image_path", "command_line", "file_path", "new_path", "module_path", "key",
    "dest_ip", "dest_port", "context_info", "sid", "size",
]
_RECORD = ["id", "hostname", "timestamp", "actorID", "objectID", "object", "action", "pid", "ppid", "principal"]

LOG_SCHEMA = T.StructType(
    [T.StructField(name, T.StringType()) for name in _RECORD]
    + [T.StructField("properties", T.StructType([T.StructField(n, T.StringType()) for n in _PROPERTIES]))]
)

# Vocabularies whose order defines feature positions.
OBJECT_TYPES = ["PROCESS", "FILE", "SHELL"]
NODE_TYPES = [
    "Node", "Process", "File", "Flow", "Module", "Thread", "Registry", "Task", "Shell", "Host", "Service",
    "User_session",
]
ACTIONS = [
    "CREATE", "DELETE", "MODIFY", "READ", "RENAME", "WRITE", "MESSAGE", "OPEN", "START", "LOAD", "TERMINATE",
    "ADD", "EDIT", "REMOVE", "COMMAND", "REMOTE_CREATE", "GRANT", "INTERACTIVE", "LOGIN", "LOGOUT", "RDP",
    "REMOTE", "UNLOCK",
]
START_ACTIONS = ["CREATE", "START", "LOAD", "ADD", "COMMAND", "LOGIN"]
END_ACTIONS = ["DELETE", "TERMINATE", "REMOVE", "LOGOUT"]
SID_CLASSES = ["18", "19", "20", "21", "90", "96"]

BATCH = 256
WINDOW_SECONDS = 900
