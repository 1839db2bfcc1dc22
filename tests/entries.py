"""Entries made by hand."""

import datetime as dt

from tracewright.schema import ENTRY


def entry(i, kind, name, direction=None, request_id=None, message="m", payload=None, cid="", component="c"):
    row = dict.fromkeys(f.name for f in ENTRY.fields)
    row |= {"file_idx": 0, "file": "f", "seq": i, "source_line_number": i + 1, "component": component, "component_id": cid, "timestamp": dt.datetime(2026, 1, 1) + dt.timedelta(seconds=i), "level": "INFO"}
    return tuple((row | {"message": message, "raw_logline": message, "structured_fields": {}, "kind": kind, "name": name, "direction": direction, "request_id": request_id, "payload_json": payload}).values())
