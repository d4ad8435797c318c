"""Record types as Spark schemas.

Absent values are zeros or empty strings at the source; readers give them as such.
Unsigned 64-bit values are kept as two's complement longs.
"""

from __future__ import annotations

ARG = "struct<name:string,type:string,value:string>"
META = "struct<cluster:string,node_name:string,namespace:string,pod:string,container:string,container_id:string,image:string,labels:map<string,string>,pid_ns:bigint,mnt_ns:bigint>"
SYSCALL = f"""seq bigint, event_id string, ts_ns bigint, pid int, tid int, ppid int, uid bigint, gid bigint, comm string, exe_path string,
 syscall_id int, syscall_name string, category string, operation string, resource string, args array<{ARG}>, retval int, ret_code string, cgroup_id bigint, meta {META}"""
INTENT = f"intent_id string, kind string, start_ns bigint, end_ns bigint, contributing_event_ids array<string>, attributes map<string,string>, meta {META}, severity int, confidence double"
DEVIATION = f"deviation_id string, profile_id string, kind string, deviation_score double, evidence string, meta {META}"
EDGE = "seq bigint, edge_id string, kind string, src string, dst string, ts_ns bigint, session_id string"
NODE = "seq bigint, id string, kind string, label string, attrs map<string,string>"
LOG_ENTRY = "seq bigint, stream string, ts_ns bigint, container_id string, body string"
RULE = "category string, path string, path_glob string, peer string, fqdn string, binary string, name string"

EDGE_KINDS = ("FORK", "EXEC", "IPC_CONNECT", "FILE_TOUCH", "SIGNAL", "PTRACE", "MOUNT_SHARE")
CORRELATIONS = ("file_written_then_executed", "exec_after_chmod_x", "connect_after_dns", "read_sensitive_before_send", "privilege_escalation_window")
