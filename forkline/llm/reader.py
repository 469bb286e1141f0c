"""What a reader of a stored e-mail sees: its text parts, decoded, without markup."""

from __future__ import annotations

import binascii
import html
import re

from forkline.llm.unicode_forms import visible

_HEADER = re.compile(r"^(content-type|content-transfer-encoding)[ \t]*:[ \t]*(.*(?:\n[ \t]+.*)*)", re.I | re.M)
_BOUNDARY = re.compile(r"""boundary[ \t]*=[ \t]*(?:"([^"\n]*)"|([^;\s]+))""", re.I)
_CHARSET = re.compile(r"""charset[ \t]*=[ \t]*["']?([\w.:-]+)""", re.I)
_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|head)\b.*?(?:</\1\s*>|\Z)", re.I | re.S)
_INLINE = re.compile(r"</?(?:a|abbr|acronym|b|bdi|bdo|big|cite|code|del|dfn|em|font|i|ins|kbd|mark|q|s|samp|small|span|strike|strong|sub|sup|tt|u|var|wbr)\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[a-z!?][^<>]*>", re.I)
_NOT_BASE64 = re.compile(r"[^A-Za-z0-9+/]+")


def _bytes_to_text(data: bytes, content_type: str) -> str:
    """UTF-8 if it is that, else the charset that is named, else Latin-1; wrong labels are common."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        named = _CHARSET.search(content_type)
        try:
            return data.decode(named[1] if named else "cp1252")
        except (LookupError, UnicodeDecodeError):
            return data.decode("utf-8", "replace") if named and named[1].lower().startswith("utf") else data.decode("latin-1")


def from_base64(body: str) -> bytes:
    """The bytes of base64 lines, also of cut ones: an incomplete last group gives what it holds."""
    packed = _NOT_BASE64.sub("", body.partition("=")[0] if body.rstrip().endswith("=") else body)
    if len(packed) % 4 == 1:
        packed = packed[:-1]
    return binascii.a2b_base64(packed + "=" * (-len(packed) % 4))


def without_markup(text: str) -> str:
    """HTML as read: hidden parts and tags go, tags that end a line of text leave a line end, references are resolved."""
    text = _HIDDEN.sub(" ", text)
    return html.unescape(_TAG.sub("\n", _INLINE.sub("", text)))


def _leaf(body: str, content_type: str, encoding: str) -> str | None:
    kind = content_type.partition(";")[0].strip().lower()
    if kind and not kind.startswith("text"):
        return None
    if encoding == "base64":
        body = visible(_bytes_to_text(from_base64(body), content_type))
    elif encoding == "quoted-printable":
        body = visible(_bytes_to_text(binascii.a2b_qp(body.encode("utf-8", "surrogatepass")), content_type))
    return without_markup(body) if kind == "text/html" else body


def visible_parts(text: str) -> list[str]:
    """The text parts that a reader sees, in order, in visible form. A text that is no e-mail is one part.

    Look-alike characters are mapped before the structure is read, so headers and encodings survive them. Cut
    messages give what is there. Attachments that are no text have no part; a message inside a message has.
    """
    out = []
    todo = [visible(text).replace("\r\n", "\n").replace("\r", "\n")]
    first = True
    while todo:
        entity = todo.pop()
        head, gap, body = entity.partition("\n\n")
        if entity.startswith("\n"):
            head, gap, body = "", "\n", entity[1:]
        fields = {m[1].lower(): m[2] for m in _HEADER.finditer(head)}
        if first and not gap:
            head, body = "", entity
        elif first and not re.match(r"[\w-]+[ \t]*:|From ", head):
            body = entity
        first = False
        content_type, encoding = fields.get("content-type", ""), fields.get("content-transfer-encoding", "").strip().lower()
        kind = content_type.partition(";")[0].strip().lower()
        mark = _BOUNDARY.search(content_type) if kind.startswith("multipart") else None
        if mark:
            pieces = re.split(r"(?:\A|\n)--" + re.escape((mark[1] or mark[2] or "").strip()) + r"(?:--)?[ \t]*(?=\n|\Z)", body)
            if len(pieces) > 1:
                todo.extend(p[1:] for p in reversed(pieces[1:]) if p.strip())
                continue
            content_type = ""
        if kind == "message/rfc822":
            todo.append(body.lstrip("\n"))
            continue
        if (part := _leaf(body, content_type, encoding)) is not None and part:
            out.append(part)
    return out
