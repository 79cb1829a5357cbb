"""All queries: importing this package registers them."""

from . import aggregates, analytics, keyspace, ranked, relations, scalars, sources, streams, strings, structures, timeseries
from .base import PLANS, Plan

__all__ = ["PLANS", "Plan", "aggregates", "analytics", "keyspace", "ranked", "relations", "scalars", "sources", "streams", "strings", "structures", "timeseries"]


#: Commands of a server process: links, replicas, clients and shutdown. Spark's cluster has its own.
SERVER = frozenset(
    "ACL ASKING AUTH BGREWRITEAOF BGSAVE CLIENT CLUSTER CLUSTERINFO CLUSTERNODES CLUSTERSLOTS CONFIG DEBUG DEBUGSEGFAULT LASTSAVE LATENCY LOLWUT MEMINFO MEMORY MONITOR PSYNC QUIT READONLY READWRITE REPLCONF REPLICAOF ROLE SAVE SENTINEL SHUTDOWN SLAVEOF SLOWLOG STRALGO SWAPDB SYNC WAIT WAITAOF".split()
)


def covering(command: str) -> list[Plan]:
    """The plans that cover a command: by its name, else by the longest family that has it."""
    while command:
        found = [p for p in PLANS.values() if command in p.commands]
        if found:
            return found
        head = command.removesuffix(".*").rpartition(".")[0]
        command = f"{head}.*" if head else ""
    return []
