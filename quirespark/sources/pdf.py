"""PDF objects: tokens, cross references, object streams, encryption with an empty password, pages.

Runs inside a Python worker, one document at a time; damage is repaired where it can be and noted.
"""

from __future__ import annotations

import hashlib
import re
from typing import Any, NamedTuple

from ..functions import codecs

WHITE, DELIMITERS = b"\0\t\n\f\r ", b"()<>[]{}/%"
_NOT = rb"[^\0\t\n\f\r ()<>\[\]{}/%]"
_TOKEN = re.compile(
    rb"(?:[\0\t\n\f\r ]|%[^\r\n]*)*(?:(?P<ref>\d+[\0\t\n\f\r ]+\d+[\0\t\n\f\r ]+R(?!" + _NOT + rb"))|(?P<num>[+-]?(?:\d+\.?\d*|\.\d+)(?!" + _NOT + rb"))|(?P<name>/" + _NOT + rb"*)|(?P<open><<|\[)|(?P<close>>>|\])|(?P<hex><[^>]*>?)|(?P<str>\()|(?P<stray>[)>{}])|(?P<word>" + _NOT + rb"+))"
)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Name(str):
    pass


class Word(str):
    """An operator or keyword."""


class Ref(NamedTuple):
    num: int
    gen: int


class Stream:
    def __init__(self, values: dict, raw: bytes):
        self.values, self.raw = values, raw


END = Word("")


class Reader:
    """Objects from bytes at a position."""

    def __init__(self, data: bytes, at: int = 0, decrypt=None):
        self.data, self.at, self.decrypt = data, at, decrypt

    def next(self) -> Any:
        while True:
            m = _TOKEN.match(self.data, self.at)
            if not m:
                self.at = len(self.data)
                return END
            self.at = m.end()
            kind = m.lastgroup
            text = m[kind]
            if kind == "num":
                return float(text) if b"." in text else int(text)
            if kind == "name":
                return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), text[1:]).decode("latin-1"))
            if kind == "ref":
                a, b, _ = text.split()
                return Ref(int(a), int(b))
            if kind == "open":
                return self._dictionary() if text == b"<<" else self._array()
            if kind == "close":
                return Word(text.decode())
            if kind == "hex":
                return self._string(codecs.ascii_hex(text[1:]))
            if kind == "str":
                return self._string(self._literal())
            if kind == "word":
                return {b"true": True, b"false": False, b"null": None}.get(text, Word(text.decode("latin-1")))
            # a stray delimiter is skipped

    def _string(self, value: bytes) -> bytes:
        return self.decrypt(value) if self.decrypt else value

    def _array(self) -> list:
        out = []
        while (x := self.next()) is not END and not (isinstance(x, Word) and x in ("]", ">>")):
            out.append(x)
        return out

    def _dictionary(self) -> dict:
        flat = []
        while (x := self.next()) is not END and not (isinstance(x, Word) and x == ">>"):
            flat.append(x)
        out, i = {}, 0
        while i < len(flat):
            if isinstance(flat[i], Name):
                out.setdefault(str(flat[i]), flat[i + 1] if i + 1 < len(flat) else None)
                i += 2
            else:
                i += 1
        return out

    def _literal(self) -> bytes:
        data, i, depth, out = self.data, self.at, 1, bytearray()
        while i < len(data):
            c = data[i : i + 1]
            if c == b"\\":
                e = data[i + 1 : i + 2]
                if m := re.compile(rb"[0-7]{1,3}").match(data, i + 1):
                    out.append(int(m[0], 8) & 255)
                    i = m.end()
                    continue
                if e in b"\r\n" and e:
                    i += 3 if data[i + 1 : i + 3] == b"\r\n" else 2
                    continue
                out += _ESCAPES.get(e, e)
                i += 2
                continue
            depth += (c == b"(") - (c == b")")
            i += 1
            if not depth:
                break
            out += c
        self.at = i
        return bytes(out)


class Document:
    """A parsed file: xref from its tables and streams, or from a scan for objects if those are damaged."""

    def __init__(self, data: bytes):
        at = data[:4101].find(b"%PDF-")
        if at < 0:
            raise ValueError("not a PDF")
        self.data, self.notes = data, []
        self.entries: dict[int, tuple] = {}
        self.trailer: dict = {}
        self.cache: dict[int, Any] = {}
        self.decrypt_with = None
        self.scanned = False
        try:
            self._read_chain()
        except (ValueError, IndexError, TypeError, KeyError, AttributeError):
            pass
        if not isinstance(self.get(self.trailer.get("Root")), dict):
            self._scan()
        if self.trailer.get("Encrypt") is not None:
            self._unlock()
            self.cache.clear()

    def note(self, text: str) -> None:
        if text not in self.notes:
            self.notes.append(text)

    # -- cross references

    def _read_chain(self) -> None:
        tail = self.data.rfind(b"startxref")
        at = int(re.match(rb"\s*(\d+)", self.data[tail + 9 :])[1])
        seen: set[int] = set()
        todo = [at]
        while todo:
            at = todo.pop(0)
            if at in seen or not 0 <= at < len(self.data):
                continue
            seen.add(at)
            m = re.compile(rb"\s*xref\s*").match(self.data, at)
            values = self._read_table(m.end()) if m else self._read_xref_stream(at)
            for k, v in values.items():
                self.trailer.setdefault(k, v)
            todo += [int(values[k]) for k in ("XRefStm", "Prev") if isinstance(values.get(k), (int, float))]

    def _read_table(self, at: int) -> dict:
        head, row = re.compile(rb"\s*(\d+)\s+(\d+)\s*"), re.compile(rb"\s*(\d{1,10})\s+(\d{1,5})\s+([nf])")
        while m := head.match(self.data, at):
            first, n, at = int(m[1]), int(m[2]), m.end()
            for i in range(n):
                if not (r := row.match(self.data, at)):
                    break
                at = r.end()
                if r[3] == b"n":
                    self.entries.setdefault(first + i, (int(r[1]), int(r[2])))
        reader = Reader(self.data, at)
        if reader.next() != "trailer":
            raise ValueError("no trailer")
        return reader.next()

    def _read_xref_stream(self, at: int) -> dict:
        obj = self._object_at(at, None)
        if not isinstance(obj, Stream):
            raise ValueError("no cross references")
        v, raw = obj.values, self.bytes_of(obj)
        w = [int(x) for x in v["W"]]
        index = v.get("Index") or [0, v["Size"]]
        p = 0
        for first, n in zip(index[::2], index[1::2], strict=False):
            for num in range(first, first + n):
                field = []
                for k in w:
                    field.append(int.from_bytes(raw[p : p + k]) if k else None)
                    p += k
                kind = 1 if field[0] is None else field[0]
                if kind == 1:
                    self.entries.setdefault(num, (field[1], field[2] or 0))
                elif kind == 2:
                    self.entries.setdefault(num, ("in", field[1], field[2] or 0))
        return v

    def _scan(self) -> None:
        """The last of each object in the file counts; the root is the trailer's, else any catalog, else the pages without a parent."""
        self.note("recovered")
        self.scanned, self.entries, self.cache = True, {}, {}
        for m in re.finditer(rb"(?<![0-9])(\d+)[\0\t\n\f\r ]+(\d+)[\0\t\n\f\r ]+obj", self.data):
            self.entries[int(m[1])] = (m.start(), int(m[2]))
        for m in re.finditer(rb"trailer", self.data):
            t = Reader(self.data, m.end()).next()
            if isinstance(t, dict):
                self.trailer |= t
        for num in list(self.entries):
            obj = self.fetch(num)
            if isinstance(obj, Stream) and self.get(obj.values.get("Type")) == "ObjStm":
                for i, (inner, _) in enumerate(self._members(obj)):
                    self.entries.setdefault(inner, ("in", num, i))
        if not isinstance(self.get(self.trailer.get("Root")), dict):
            held = {n: o for n in self.entries if isinstance(o := self.fetch(n), dict)}
            roots = [n for n, o in held.items() if self.get(o.get("Type")) == "Catalog"]
            if roots:
                self.trailer["Root"] = Ref(roots[-1], 0)
            elif tops := [n for n, o in held.items() if self.get(o.get("Type")) == "Pages" and "Parent" not in o]:
                self.trailer["Root"] = {"Pages": Ref(tops[-1], 0)}

    # -- objects

    def get(self, value: Any) -> Any:
        for _ in range(32):
            if not isinstance(value, Ref):
                return value
            value = self.fetch(value.num)
        return None

    def fetch(self, num: int) -> Any:
        if num in self.cache:
            return self.cache[num]
        self.cache[num] = None  # a cycle ends here
        entry = self.entries.get(num)
        out = None
        if entry and entry[0] == "in":
            holder = self.fetch(entry[1])
            if isinstance(holder, Stream):
                members = self._members(holder)
                found = [at for n, at in members if n == num] or [members[entry[2]][1]] if entry[2] < len(members) else []
                if found:
                    out = Reader(self.bytes_of(holder), found[0]).next()
        elif entry:
            try:
                out = self._object_at(entry[0], num)
            except ValueError:
                if not self.scanned:
                    self._scan()
                    out = self.fetch(num) if num in self.entries else None
        self.cache[num] = out
        return out

    def _members(self, holder: Stream) -> list[tuple[int, int]]:
        reader, first = Reader(self.bytes_of(holder)), int(self.get(holder.values.get("First")) or 0)
        out = []
        for _ in range(int(self.get(holder.values.get("N")) or 0)):
            n, at = reader.next(), reader.next()
            if isinstance(n, int) and isinstance(at, int):
                out.append((n, first + at))
        return out

    def _object_at(self, at: int, num: int | None) -> Any:
        m = re.compile(rb"[\0\t\n\f\r ]*(\d+)[\0\t\n\f\r ]+(\d+)[\0\t\n\f\r ]+obj").match(self.data, at)
        if not m or num is not None and int(m[1]) != num:
            raise ValueError("no such object here")
        own = (int(m[1]), int(m[2]))
        decrypt = (lambda b: self.decrypt_with(b, *own)) if self.decrypt_with else None
        reader = Reader(self.data, m.end(), decrypt)
        obj = reader.next()
        if isinstance(obj, dict) and (s := re.compile(rb"[\0\t\n\f\r ]*stream(\r\n|\n|\r)?").match(self.data, reader.at)):
            raw = self._stream_bytes(s.end(), obj)
            kind = obj.get("Type")
            if self.decrypt_with and kind != "XRef":
                raw = self.decrypt_with(raw, *own)
            return Stream(obj, raw)
        return obj

    def _stream_bytes(self, at: int, values: dict) -> bytes:
        """By /Length if endstream follows within 20 bytes, else up to endstream."""
        n = self.get(values.get("Length"))
        if isinstance(n, int) and n >= 0 and b"endstream" in self.data[at + n : at + n + 29]:
            return self.data[at : at + n]
        end = self.data.find(b"endstream", at)
        raw = self.data[at : end if end >= 0 else len(self.data)]
        return raw[:-2] if raw.endswith(b"\r\n") else raw[:-1] if raw[-1:] in (b"\n", b"\r") else raw

    def filters(self, values: dict) -> tuple[list[str], list[dict]]:
        as_list = lambda v: [self.get(x) for x in v] if isinstance(v, list) else [] if v is None else [v]
        names = as_list(self.get(values.get("Filter", values.get("F"))))
        params = as_list(self.get(values.get("DecodeParms", values.get("DP"))))
        return [str(n) for n in names if isinstance(n, Name)], [{k: self.get(v) for k, v in p.items()} if isinstance(p, dict) else {} for p in params]

    def bytes_of(self, stream: Stream) -> bytes:
        return codecs.filtered(stream.raw, *self.filters(stream.values))

    # -- encryption

    def _unlock(self) -> None:
        e = self.get(self.trailer["Encrypt"])
        g = lambda k, default=None: default if self.get(e.get(k)) is None else self.get(e.get(k))
        v, r, bits, method, identity = g("V", 0), g("R", 2), g("Length", 40), "V2", False
        if v >= 4:
            name = str(g("StmF", "Identity"))
            identity = name == "Identity"
            cf = self.get((g("CF") or {}).get(name)) or {}
            method = str(self.get(cf.get("CFM")) or method)
            if n := self.get(cf.get("Length")):
                bits = n * 8 if n <= 40 else n
        ids = self.get(self.trailer.get("ID")) or [b""]
        if r >= 5:
            u = g("U", b"")
            if codecs.hardened_hash(b"", u[32:40], r) != u[:32]:
                self.note("password")
            key = codecs.hardened_hash(b"", u[40:48], r)
            if ue := g("UE"):
                key = codecs.aes_cbc_decrypt(key, ue, bytes(16), False)[:32]
        else:
            key = codecs.key_of_empty_password(r, g("O", bytes(32)), int(g("P", 0)), self.get(ids[0]) or b"", bits, g("EncryptMetadata", True) is not False)
        aes = method in ("AESV2", "AESV3")

        def decrypt(data: bytes, num: int, gen: int) -> bytes:
            own = key
            if r < 5:
                own = hashlib.md5(key + num.to_bytes(4, "little")[:3] + gen.to_bytes(4, "little")[:2] + b"sAlT" * aes).digest()[: min(len(key) + 5, 16)]
            return codecs.aes_cbc_decrypt(own, data) if aes else codecs.rc4(own, data)

        if not identity:
            self.decrypt_with = decrypt

    # -- document level

    def pages(self) -> list[dict]:
        """Page dictionaries in order, with what they inherit."""
        out: list[dict] = []
        seen: set[int] = set()

        def walk(ref: Any, inherited: dict, depth: int) -> None:
            node = self.get(ref)
            if not isinstance(node, dict) or depth > 64 or len(out) >= 5000 or isinstance(ref, Ref) and ref.num in seen:
                return
            if isinstance(ref, Ref):
                seen.add(ref.num)
            own = inherited | {k: node[k] for k in ("Resources", "MediaBox", "CropBox", "Rotate") if k in node}
            kids = self.get(node.get("Kids"))
            if isinstance(kids, list):
                for kid in kids:
                    walk(kid, own, depth + 1)
            else:
                out.append(own | node)

        root = self.get(self.trailer.get("Root")) or {}
        walk(root.get("Pages"), {}, 0)
        if not out:
            out = [o for n in sorted(self.entries) if isinstance(o := self.fetch(n), dict) and self.get(o.get("Type")) == "Page"]
        return out

    def content(self, page: dict) -> bytes:
        c = self.get(page.get("Contents"))
        streams = [self.get(x) for x in c] if isinstance(c, list) else [c]
        return b"\n".join(self.bytes_of(s) for s in streams if isinstance(s, Stream))

    def text(self, value: Any) -> str | None:
        b = self.get(value)
        if not isinstance(b, bytes):
            return None
        if b[:2] == b"\xfe\xff":
            return b[2:].decode("utf-16-be", "replace")
        return b[3:].decode("utf-8", "replace") if b[:3] == b"\xef\xbb\xbf" else b.decode("latin-1")

    def info(self) -> dict[str, str | None]:
        held = self.get(self.trailer.get("Info"))
        return {k.lower(): (self.text(held.get(k)) or "").strip() or None if isinstance(held, dict) else None for k in ("Title", "Author", "Subject", "Creator", "Producer")}

    def outline(self) -> list[tuple[int, str]]:
        out: list[tuple[int, str]] = []

        def walk(ref: Any, depth: int) -> None:
            node, n = self.get(ref), 0
            while isinstance(node, dict) and n < 500 and depth < 8:
                n += 1
                if (title := self.text(node.get("Title"))) is not None:
                    out.append((depth, title))
                if node.get("First") is not None:
                    walk(node["First"], depth + 1)
                node = self.get(node.get("Next"))

        root = self.get((self.get(self.trailer.get("Root")) or {}).get("Outlines"))
        if isinstance(root, dict):
            walk(root.get("First"), 0)
        return out

    def hidden_layers(self) -> set[int]:
        """Object numbers of optional content that is off by default."""
        oc = self.get((self.get(self.trailer.get("Root")) or {}).get("OCProperties"))
        d = self.get(oc.get("D")) if isinstance(oc, dict) else None
        if not isinstance(d, dict):
            return set()
        refs = lambda v: {x.num for x in self.get(v) or [] if isinstance(x, Ref)}
        off = refs(d.get("OFF"))
        if self.get(d.get("BaseState")) == "OFF":
            off = (off | refs(oc.get("OCGs"))) - refs(d.get("ON"))
        return off
