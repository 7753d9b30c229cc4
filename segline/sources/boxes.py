"""What the boxes of a media file say."""

from __future__ import annotations

import struct

_PARENTS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"moof", b"traf", b"sinf", b"schi"}
_ENTRY_HEAD = {b"encv": 78, b"enca": 28}
#: Boxes that hold facts or others that do.
HEADERS = _PARENTS | set(_ENTRY_HEAD) | {b"stsd", b"tfdt", b"mdhd", b"schm", b"tenc", b"sgpd"}


#: Errors that judge a file which could be walked to its end.
JUDGED = (None, "no timescale", "missing moof box", "missing mdat box", "missing tfdt box")


def _boxes(data: bytes, at: int = 0, stop: int | None = None):
    """(type, body start, end) in reading order; a box that leaves its parent ends the walk of that parent."""
    stop = len(data) if stop is None else stop
    while at + 8 <= stop:
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1 and at + 16 <= stop:
            size, body = struct.unpack_from(">Q", data, at + 8)[0], at + 16
        elif size == 0:
            size = stop - at
        if size < body - at or at + size > stop:
            raise ValueError(f"box {kind.decode('latin-1')} is cut off")
        yield kind, body, at + size
        if kind in _PARENTS:
            yield from _boxes(data, body, at + size)
        elif kind == b"stsd":
            yield from _boxes(data, body + 8, at + size)
        elif kind in _ENTRY_HEAD:
            yield from _boxes(data, body + _ENTRY_HEAD[kind], at + size)
        at += size


def box_facts(data: bytes) -> dict:
    """What one file's boxes say; `error` names what is wrong with it."""
    out = {"has_moof": False, "has_mdat": False, "has_moov": False, "start_pts": None, "timescale": None, "scheme": None, "kids": [], "n_tracks": 0, "error": None}
    try:
        for kind, a, b in _boxes(data):
            if kind in (b"moof", b"mdat", b"moov"):
                out["has_" + kind.decode()] = True
            elif kind == b"tfdt" and out["start_pts"] is None:
                out["start_pts"] = struct.unpack_from(">Q" if data[a] == 1 else ">I", data, a + 4)[0]
            elif kind == b"mdhd" and out["timescale"] is None:
                out["timescale"] = struct.unpack_from(">I", data, a + (20 if data[a] == 1 else 12))[0]
            elif kind in _ENTRY_HEAD:
                out["n_tracks"] += 1
            elif kind == b"schm" and out["scheme"] is None:
                out["scheme"] = data[a + 4 : a + 8].decode("latin-1")
            elif kind == b"tenc" and b - a >= 24:
                out["kids"].append(data[a + 8 : a + 24].hex())
            elif kind == b"sgpd" and data[a + 4 : a + 8] == b"seig":
                version = data[a]
                at = a + (12 if version == 1 else 8)
                fixed = struct.unpack_from(">I", data, a + 8)[0] if version == 1 else 0
                (n,) = struct.unpack_from(">I", data, at)
                at += 4
                for _ in range(n):
                    size = fixed or struct.unpack_from(">I", data, at)[0]
                    at += 0 if fixed else 4
                    if data[at + 2]:
                        out["kids"].append(data[at + 4 : at + 20].hex())
                    at += size
        out["kids"] = list(dict.fromkeys(out["kids"]))
        if out["has_moov"]:
            out["error"] = None if out["timescale"] else "no timescale"
        elif not out["has_moof"]:
            out["error"] = "missing moof box"
        elif not out["has_mdat"]:
            out["error"] = "missing mdat box"
        elif out["start_pts"] is None:
            out["error"] = "missing tfdt box"
    except (ValueError, struct.error, IndexError) as e:
        out["error"] = str(e) or "cut off"
    return out


FACTS = "has_moof boolean, has_mdat boolean, has_moov boolean, start_pts bigint, timescale bigint, scheme string, kids array<string>, n_tracks int, error string"
