"""Letters and calendars: keys of a letter, its summary, and events."""

from __future__ import annotations

import email
import email.policy
import hashlib
import re
from datetime import UTC, datetime
from email.message import EmailMessage
from email.utils import parseaddr, parsedate_to_datetime

from pyspark.sql import DataFrame

from lodestone.sources.extract import _per_file, split_visible


def header(letter: EmailMessage, name: str) -> str | None:
    try:
        value = letter.get(name)
    except (ValueError, IndexError, AttributeError, TypeError):  # a header that the parser can't take apart
        return None
    return None if value is None else str(value)


def body(letter: EmailMessage) -> str:
    """The plain part, else the shown text of the markup part."""
    part = letter.get_body(("plain", "html"))
    if part is None:
        return ""
    try:
        text = part.get_content()
    except (LookupError, UnicodeError, ValueError):
        return ""
    return split_visible(text)[0] if part.get_content_subtype() == "html" else text


def moment(value: str | None) -> datetime | None:
    try:
        found = parsedate_to_datetime(value) if value else None
    except (TypeError, ValueError, OverflowError):
        return None
    return found.replace(tzinfo=UTC) if found is not None and found.tzinfo is None else found


def keys(data: bytes, this_year: int) -> tuple[str | None, str | None, str | None]:
    """(message id, fingerprint, day by the sender's clock) of a letter."""
    letter = email.message_from_bytes(data, policy=email.policy.default)
    mid = re.sub(r"\s+", "", header(letter, "Message-ID") or "").strip("<>").lower() or None
    sender, date, subject = (header(letter, k) for k in ("From", "Date", "Subject"))
    sent = moment(date)
    fp = None
    if sender or date or subject:
        minute = sent.astimezone(UTC).strftime("%Y%m%d%H%M") if sent else ""
        start = re.sub(r"[\W_]+", "", body(letter).lower())[:200]
        fp = hashlib.sha256("|".join((parseaddr(sender or "")[1].lower(), minute, " ".join((subject or "").split()).lower(), start)).encode()).hexdigest()[:32]
    stamps = [str(r).rsplit(";", 1)[-1].strip() for r in reversed(letter.get_all("Received") or [])]
    days = [m for m in (sent, *map(moment, stamps)) if m is not None and 1990 <= m.year <= this_year + 1]
    return mid, fp, days[0].strftime("%Y-%m-%d") if days else None


def parts(data: bytes) -> list[tuple[str, bytes]]:
    """Attachments of a letter, and of the letters in it (which are parts as well): name and content; a bad part has none."""
    out = []
    for part in email.message_from_bytes(data, policy=email.policy.default).walk():
        name = part.get_filename()
        if part.get_content_type() == "message/rfc822":
            out.append((name or "letter.eml", part.get_payload(0).as_bytes() if part.is_multipart() else b""))
        elif name:
            content = part.get_payload(decode=True)
            out.append((name, content if isinstance(content, bytes) else b""))
    return out


def events(data: str) -> list[dict[str, str]]:
    """Events of a calendar: folded lines joined, escapes undone; start, end, summary and place as they're written."""
    found: list[dict[str, str]] = []
    now: dict[str, str] | None = None
    names = {"DTSTART": "start", "DTEND": "end", "SUMMARY": "summary", "LOCATION": "place"}
    for line in re.sub(r"\r?\n[ \t]", "", data).splitlines():
        if line.upper() == "BEGIN:VEVENT":
            now = {}
        elif line.upper() == "END:VEVENT" and now is not None:
            found.append(now)
            now = None
        elif now is not None:
            m = re.match(r'([A-Za-z-]+)(?:;(?:[^":]|"[^"]*")*)?:(.*)', line)
            if m and m[1].upper() in names:
                now.setdefault(names[m[1].upper()], re.sub(r"\\([nN,;\\])", lambda e: {"n": "\n", "N": "\n"}.get(e[1], e[1]), m[2]))
    return found


def letter_keys(files: DataFrame, this_year: int) -> DataFrame:
    """name, mid, fp, date of each letter among files (name, content)."""
    return _per_file(files, "name string, mid string, fp string, date string", lambda r: [(r.name, *keys(r.content, this_year))])
