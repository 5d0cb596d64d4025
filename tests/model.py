"""Slow row-by-row models of the apply rules, used only to check results."""

from __future__ import annotations

import re


def file_seq(name):
    found = re.search(r"(\d+)$", name or "")
    return int(found.group(1)) if found else -1


class MetaModel:
    """Version-guarded apply, one transaction after the other."""

    def __init__(self):
        self.done, self.values, self.meta = set(), {}, {}

    def apply(self, txn):
        if txn["id"] in self.done:
            return "DUPLICATE"
        for index, row in enumerate(txn["rows"]):
            key = (row["table"], row["key"])
            version = (file_seq(txn["file"]), txn["pos"], row.get("index", index))
            if key in self.meta and not version > self.meta[key][1]:
                continue
            deleted = row["op"] == "DELETE"
            if deleted:
                self.values.pop(key, None)
            else:
                self.values[key] = row["after"]
            self.meta[key] = (deleted, version)
        self.done.add(txn["id"])
        return "APPLIED"


class SimpleModel:
    """Arrival-order apply."""

    def __init__(self):
        self.done, self.values = set(), {}

    def apply(self, txn):
        if txn["id"] in self.done:
            return "DUPLICATE"
        for row in txn["rows"]:
            key = (row["table"], row["key"])
            if row["op"] == "DELETE":
                self.values.pop(key, None)
            else:
                self.values[key] = row["after"]
        self.done.add(txn["id"])
        return "APPLIED"


def assemble(entries, configured):
    """Transactions of raw log entries: (xid, position, [(table, op, n)]), and the number of open rows."""
    mapping, buffer, out = {}, [], []
    for e in entries:
        if e["type"] == "TABLE_MAP":
            mapping[(e["connector"], e["table_id"])] = e["table_name"]
        elif e["type"] == "XID":
            if buffer:
                out.append((e["xid"], e["file"], e["pos"], list(buffer)))
            buffer = []
        elif e["type"] in ("WRITE", "UPDATE", "DELETE"):
            table = mapping.get((e["connector"], e["table_id"]))
            if table in configured:
                buffer += [(table, e["type"], r["after"] or r["before"]) for r in e["rows"]]
    return out, len(buffer)
