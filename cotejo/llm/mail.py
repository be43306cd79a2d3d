"""The author's own text of a raw e-mail message.

A small reader for the parts of MIME that matter here: header block, nested
multiparts, transfer encodings.  Attachments are skipped without decoding.
Every function takes whole texts and never raises on damaged input.
"""

from __future__ import annotations

import base64
import binascii
import html
import quopri
import re

_HEADER = re.compile(r"[A-Za-z][A-Za-z0-9\-]*:")
_BOUNDARY = re.compile(r'boundary\s*=\s*(?:"([^"]+)"|([^\s;"]+))', re.I)
_CHARSET = re.compile(r'charset\s*=\s*"?([A-Za-z0-9_\-]+)', re.I)

# fixed values: how mail programs introduce quoted messages
_QUOTE_HEAD = re.compile(
    r"^\s*(?:(?:on|el|em|le|il|am)\b.{0,160}\b(?:wrote|escribi[^\s:]{1,3}|escreveu|ha scritto|a écrit|schrieb)\s*:\s*$"
    r"|-{2,}\s*(?:mensaje original|original message|mensagem original|forwarded message|mensaje reenviado|mensagem encaminhada)\s*-{2,}\s*$)",
    re.I,
)
_QUOTE_FIELD = re.compile(r"^\s*(?:de|from|enviado|sent|enviada|asunto|subject|assunto|para|to|cc|fecha|date|data)\s*:", re.I)
_PREFIX = re.compile(r"^\s*[>|]")
_SIGN = re.compile(r"^\s*(?:--|__+|-{3,}|={3,}|\*{3,})\s*$")
# fixed values: closing lines, folded to letters
_CLOSING = {
    "saludos", "saludos cordiales", "cordiales saludos", "un saludo", "atte", "atentamente", "atentos saludos", "quedo atento a", "quedo atenta", "quedo atento", "quedo atento/a", "un abrazo", "abrazos", "cordialmente", "saluda atentamente", "gracias y saludos", "muchas gracias", "gracias",
    "regards", "kind regards", "best regards", "best", "cheers", "thanks", "many thanks", "sincerely", "yours sincerely", "yours faithfully", "thank you",
    "atenciosamente", "obrigado", "obrigada", "obrigado a", "abraco", "abracos", "um abraco", "cumprimentos", "att", "grato", "grata", "sds",
}
# fixed values: openings of notices that mail systems append
_NOTICE = re.compile(
    r"^\s*(?:\W*)(?:aviso legal|aviso de confidencialidad|confidencialidad|confidentiality|confidential|disclaimer|legal notice|aviso de confidencialidade|confidencialidade|nota de confidencialidad"
    r"|antes de imprimir|please consider the environment|before printing|think before|este mensaje y sus|esta mensagem|este correo electr|this e-?mail|this message (?:is|and|may|contains)|pense no meio|considere o meio|antes de imprimir este)",
    re.I,
)
_GREETING = re.compile(
    r"^\s*(?:hola|estimad[oa](?:/a)?s?|querid[oa]s?|buen[oa]s?(?: d[ií]as| tardes| noches)?|bom dia|boa (?:tarde|noite)|prezad[oa](?:\(a\))?s?|car[oa]s?|ol[aá]|hi|hello|dear|hey|good (?:morning|afternoon|evening)|oi)\b[^.!?;]{0,40}[,:!\-]*\s*$"
    r"|^\s*[^\W\d_]+(?: [^\W\d_]+)?\s*(?:[:,]|\s-)\s*$",
    re.I,
)
_FOLD = str.maketrans("áàâãäéêíóôõúüçñ", "aaaaaeeiooouucn")


def _split(text: str) -> tuple[str, str]:
    """Header block (unfolded, lower-cased names are the caller's business) and body."""
    if text.startswith("From ") and "\n" in text:
        text = text.split("\n", 1)[1]
    if not _HEADER.match(text):
        return "", text.lstrip("\n") if text.startswith("\n") else text
    head, gap, body = text.partition("\n\n")
    return head.replace("\n\t", " ").replace("\n ", " "), body if gap else ""


def _field(head: str, name: str) -> str:
    m = re.search(rf"^{name}[ \t]*:(.*)$", head, re.I | re.M)
    return m.group(1).strip() if m else ""


def _decode(body: str, encoding: str, charset: str) -> str:
    if encoding == "base64":
        raw = re.sub(r"[^A-Za-z0-9+/]", "", body)
        raw = raw[: len(raw) - (1 if len(raw) % 4 == 1 else 0)]
        try:
            data = base64.b64decode(raw + "=" * (-len(raw) % 4))
        except (binascii.Error, ValueError):
            return body
    elif encoding == "quoted-printable":
        data = quopri.decodestring(body.encode("utf-8", "replace"))
    else:
        return body
    try:
        return data.decode(charset or "utf-8")
    except (LookupError, UnicodeDecodeError):
        try:
            return data.decode("utf-8", "replace" if charset in ("", "utf-8") else "strict")
        except UnicodeDecodeError:
            return data.decode("latin-1")


def _strip_html(s: str) -> str:
    s = re.sub(r"(?is)<(style|script|head)\b.*?</\1>", " ", s)
    while True:  # innermost quotes first
        t = re.sub(r"(?is)<blockquote\b[^>]*>(?:(?!<blockquote\b).)*?</blockquote>", "\n\n", s)
        if t == s:
            break
        s = t
    s = re.sub(r"(?is)<blockquote\b.*", "", s)
    s = re.sub(r"(?i)<br\s*/?>|</(?:div|tr|li|h\d)>", "\n", s)
    s = re.sub(r"(?i)<p\b[^>]*>", "\n\n", s)
    return html.unescape(re.sub(r"<[^>]*>", "", s))


def _parts(head: str, body: str, kind: str) -> list[str] | None:
    """Raw parts of a multipart body, in order; null if it is none."""
    m = _BOUNDARY.search(_field(head, "content-type"))
    mark = (m.group(1) or m.group(2)) if m else ""
    if not mark and not kind.startswith("text/"):
        m = re.search(r"^--(\S{6,})\nContent-", body, re.M | re.I)
        mark = m.group(1) if m else ""
    if not mark:
        return None
    # a nested boundary may begin with the outer one, so the line has to end after it
    pieces = re.split(rf"(?:^|\n)--{re.escape(mark)}(--)?[ \t]*(?=\n|$)", body)
    found = []
    for closing, part in zip(pieces[1::2], pieces[2::2], strict=False):
        if closing:
            break
        found.append(part.removeprefix("\n"))
    return found if found or kind.startswith("multipart/") else None


def _texts(text: str) -> list[tuple[str, str]]:
    """(kind, text) of the parts that aren't attachments, nested to any depth; kind is plain or html."""
    out: list[tuple[str, str]] = []
    waiting = [text]
    while waiting:
        head, body = _split(waiting.pop())
        kind = _field(head, "content-type").lower()
        if "attachment" in _field(head, "content-disposition").lower():
            continue
        parts = _parts(head, body, kind)
        if parts is not None:
            waiting += reversed(parts)
            continue
        if kind and not kind.startswith(("text/plain", "text/html")):
            continue
        m = _CHARSET.search(kind)
        got = _decode(body, _field(head, "content-transfer-encoding").lower(), m.group(1) if m else "")
        out.append(("html" if kind.startswith("text/html") else "plain", got.replace("\r\n", "\n").replace("\r", "\n")))
    return out


def _own_lines(text: str) -> str:
    """Drop quotes, greeting, closing, signature and notices from a decoded body."""
    kept: list[str] = []
    quoted = False  # inside an unmarked quote
    fields = False  # in the field lines under 'original message'
    signed = False
    some = False
    for line in text.split("\n"):
        bare = line.strip()
        if _PREFIX.match(line):
            continue
        if _QUOTE_HEAD.match(bare):
            if some or signed:  # below the author's text everything is quoted
                break
            quoted = fields = True
            continue
        if quoted:
            if not bare:
                quoted = fields = False
            continue
        if signed:
            continue
        if not bare:
            kept.append("")
            continue
        if _SIGN.match(bare):
            signed = True
            continue
        key = re.sub(r"[^a-z/ ]+", " ", bare.lower().translate(_FOLD)).strip()
        if len(bare) < 40 and (key in _CLOSING or key.replace("/", " ") in _CLOSING):
            signed = some
            continue
        if _NOTICE.match(bare):
            signed = some
            quoted = not some
            continue
        if not some and len(bare) < 60 and _GREETING.match(bare):
            continue
        some = True
        kept.append(bare)
    return "\n".join(kept).strip()


def own_text(raw: str | None) -> str:
    """What the author of a message wrote; '' for null, empty or text-less messages."""
    if not raw:
        return ""
    parts = _texts(raw.replace("\r\n", "\n").replace("\r", "\n"))
    plain = "\n\n".join(t for k, t in parts if k == "plain")
    own = _own_lines(plain) if plain else ""
    if not own:
        page = "\n\n".join(_strip_html(t) for k, t in parts if k == "html")
        own = _own_lines(page) if page else ""
    return own
