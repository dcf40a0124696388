"""Mail decoders (S04-S07, F32-F36, F42): Arrow-batched functions on the standard library's parsers."""

from __future__ import annotations

import base64
import email
import email.policy
import email.utils
import hashlib
import json
import quopri
import re
from email.header import decode_header, make_header

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .html import _parsed

HINTS = T.StructType([*(T.StructField(n, T.BooleanType()) for n in ("newsletter", "bulk", "no_reply", "auto_submitted")), T.StructField("reply_to", T.StringType()), T.StructField("organization", T.StringType())])
MAIL = T.StructType(
    [
        *(T.StructField(n, T.StringType()) for n in ("msg_id", "subject", "sender", "recipient")),
        T.StructField("date", T.TimestampType()),
        *(T.StructField(n, T.StringType()) for n in ("body", "body_html", "organizer")),
        T.StructField("header_hints", HINTS),
        T.StructField("error", T.StringType()),
    ]
)
_ORGANIZER = re.compile(r"ORGANIZER[^:\n]*:(?:mailto:)?([^\s;]+@[^\s;]+)", re.IGNORECASE)


def header_text(raw: str | None) -> str | None:
    """an RFC 2047 header as text; what cannot be decoded stays as it is."""
    if raw is None:
        return None
    try:
        return str(make_header(decode_header(raw)))
    except (LookupError, ValueError):
        return raw


def transfer_decoded(body: str | None, encoding: str | None) -> str | None:
    """F32: base64 (either alphabet), quoted-printable, or as it is."""
    if body is None:
        return None
    kind = (encoding or "").lower()
    if kind == "base64":
        data = re.sub(r"\s", "", body).replace("-", "+").replace("_", "/")
        try:
            return base64.b64decode(data + "=" * (-len(data) % 4)).decode("utf-8", "replace")
        except ValueError:
            return body
    if kind == "quoted-printable":
        return quopri.decodestring(body.encode("utf-8", "surrogateescape")).decode("utf-8", "replace")
    return body


def _payload(part: email.message.Message) -> str:
    data = part.get_payload(decode=True) or b""
    try:
        return data.decode(part.get_content_charset() or "utf-8", "replace")
    except LookupError:
        return data.decode("utf-8", "replace")


def decode_mail(raw: str | bytes | None, html_first: bool = False, need_id: bool = False) -> dict:
    """Headers, first text part, first HTML part, calendar organizer and hints of one raw message.

    S06: with ``html_first`` the HTML part's text is the body even where there is a plain part, and the id is always the one made from
    subject, date and sender. S07: with ``need_id`` a message without an id of its own is an error.
    """
    empty = {f.name: None for f in MAIL}
    if raw is None:
        return empty | {"error": "null"}
    m = email.message_from_bytes(raw) if isinstance(raw, bytes) else email.message_from_string(raw)
    text = html = calendar = None
    for part in m.walk():  # depth first, so the first of each kind wins
        if part.is_multipart() or part.get_content_disposition() == "attachment":
            continue
        kind = part.get_content_type()
        if kind == "text/plain" and text is None:
            text = _payload(part)
        elif kind == "text/html" and html is None:
            html = _payload(part)
        elif kind == "text/calendar" and calendar is None:
            calendar = _payload(part)
    if html is not None and (text is None or html_first):
        text = " ".join(" ".join(_parsed(html).parts).split())
    try:
        date = email.utils.parsedate_to_datetime(m["Date"]) if m["Date"] else None
    except (TypeError, ValueError):
        date = None
    sender = header_text(m["From"])
    organizer = _ORGANIZER.search(calendar) if calendar else None
    head = lambda k: (m[k] or "").lower()
    hints = {
        "newsletter": m["List-Unsubscribe"] is not None or m["List-Id"] is not None,
        "bulk": head("Precedence") in ("bulk", "list", "junk"),
        "no_reply": bool(re.search(r"no-?reply|do-?not-?reply", head("From"))),
        "auto_submitted": head("Auto-Submitted") not in ("", "no"),
        "reply_to": header_text(m["Reply-To"]),
        "organization": header_text(m["Organization"]),
    }
    subject = header_text(m["Subject"]) or ""
    own = "" if html_first else (m["Message-ID"] or "").strip("<> \t")
    msg_id = own or hashlib.md5(f"{subject}{m['Date'] or ''}{sender or ''}".encode()).hexdigest()
    error = "no headers" if not (m["From"] or m["Subject"]) else "no message id" if need_id and not own else None
    return {"msg_id": msg_id, "subject": subject, "sender": sender, "recipient": header_text(m["To"]), "date": date, "body": text, "body_html": html, "organizer": organizer[1].lower() if organizer else None, "header_hints": hints, "error": error}


def _utc(d):  # noqa: ANN001, ANN202  a datetime or None
    if d is None:
        return None
    stamp = pd.Timestamp(d)
    return (stamp.tz_localize("UTC") if stamp.tz is None else stamp.tz_convert("UTC")).tz_localize(None)


def _frame(raw: pd.Series, **how) -> pd.DataFrame:
    rows = [decode_mail(x, **how) for x in raw]
    out = pd.DataFrame(rows, columns=[f.name for f in MAIL])
    out["date"] = pd.to_datetime(pd.Series([_utc(r["date"]) for r in rows], dtype="object"))
    out["header_hints"] = [r["header_hints"] or dict.fromkeys(HINTS.names) for r in rows]
    return out


@F.pandas_udf(MAIL)
def decoded(raw: pd.Series) -> pd.DataFrame:
    """A raw RFC 822 message as a struct; the instant in UTC (a naive date counts as UTC), null if it cannot be read."""
    return _frame(raw)


@F.pandas_udf(MAIL)
def decoded_html_first(raw: pd.Series) -> pd.DataFrame:
    """S06"""
    return _frame(raw, html_first=True)


@F.pandas_udf(MAIL)
def decoded_with_id(raw: pd.Series) -> pd.DataFrame:
    """S07"""
    return _frame(raw, need_id=True)


@F.pandas_udf(T.StringType())
def rfc2047(raw: pd.Series) -> pd.Series:
    return raw.map(header_text)


@F.pandas_udf(T.StringType())
def transfer_decode(body: pd.Series, encoding: pd.Series) -> pd.Series:
    return pd.Series([transfer_decoded(b, e) for b, e in zip(body, encoding, strict=True)])


def api_metadata(raw: str | Column) -> Column:
    """Headers, label ids and instants of an API message in JSON; its parts nest to any depth, see ``api_body``."""
    schema = "id string, threadId string, labelIds array<string>, internalDate string, payload struct<headers:array<struct<name:string,value:string>>>"
    return F.from_json(raw, schema)


def _api_text(part: dict) -> str | None:
    data = (part.get("body") or {}).get("data")
    return transfer_decoded(data, (part.get("body") or {}).get("encoding", "base64")) if data else None


def api_parts(payload: dict) -> tuple[str | None, str | None]:
    """(body, HTML) of an API message's payload: the first HTML part at any depth, in the order of the parts, and its
    text; without one the first plain part; without parts the payload's own data. Attachments (parts with a file name) are passed over."""
    plain = html = None
    waiting = list(reversed(payload.get("parts") or []))
    while waiting:
        part = waiting.pop()
        waiting += reversed(part.get("parts") or [])
        if part.get("filename"):
            continue
        if part.get("mimeType") == "text/html" and html is None:
            html = _api_text(part)
        elif part.get("mimeType") == "text/plain" and plain is None:
            plain = _api_text(part)
    own = _api_text(payload) if plain is None and html is None else None
    if own is not None and payload.get("mimeType") == "text/html":
        html, own = own, None
    return (" ".join(" ".join(_parsed(html).parts).split()) if html is not None else plain if plain is not None else own), html


@F.pandas_udf(T.StructType([T.StructField("body", T.StringType()), T.StructField("body_html", T.StringType())]))
def api_body(raw: pd.Series) -> pd.DataFrame:
    """Body and HTML of API messages in JSON; nulls where it can't be read."""
    out = []
    for x in raw:
        try:
            out.append(api_parts(json.loads(x)["payload"]))
        except (TypeError, ValueError, KeyError, AttributeError):
            out.append((None, None))
    return pd.DataFrame(out, columns=["body", "body_html"])


def header(message: Column, name: str) -> Column:
    """The value of the first header of a name, whatever the case."""
    return F.get(F.filter(message["payload"]["headers"], lambda h: F.lower(h["name"]) == name.lower()), F.lit(0))["value"]


def parsed_date(value: str | Column) -> Column:
    """an RFC 2822 date by built-in parsing, with and without the week's day; null otherwise."""
    c = F.regexp_replace(F.col(value) if isinstance(value, str) else value, r"\s*\([^)]*\)\s*$", "")
    c = F.regexp_replace(c, r"^\s*[A-Za-z]{3},\s*", "")
    return F.coalesce(*(F.try_to_timestamp(c, F.lit(p)) for p in ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm Z")))
