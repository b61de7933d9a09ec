"""Dates, deltas and path templates, all on the driver."""

from __future__ import annotations

import datetime
import re

TEMPLATE = "{date}"
DAY_TEMPLATE = "year_{yyyy}/month_{mm}/day_{dd}"
_DELTA = re.compile(r"\s*".join(rf"(?:(-?\d+){unit})?" for unit in ("w(?:eeks?)?", "d(?:ays?)?", "h(?:ours?)?", "m(?:in(?:utes?)?)?", "s(?:ec(?:onds?)?)?")), re.I)


def parse_delta(text: str) -> datetime.timedelta:
    """'3d5h', '2 weeks', '-90m', '1d-2h' as a duration; ValueError if it is none."""
    s = (text or "").strip()
    m = _DELTA.fullmatch(re.sub(r"(?<=\d)\s+(?=[a-z])", "", s, flags=re.I))
    if not s or m is None:
        raise ValueError(f"not a duration: {text!r}")
    w, d, h, mi, sec = (int(x or 0) for x in m.groups())
    return datetime.timedelta(weeks=w, days=d, hours=h, minutes=mi, seconds=sec)


def as_datetime(value) -> datetime.datetime:
    """A date, datetime or ISO string as a datetime without zone."""
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, datetime.date):
        return datetime.datetime(value.year, value.month, value.day)
    return datetime.datetime.fromisoformat(str(value).replace("Z", "").split("+")[0])


def fill(template: str, at: datetime.datetime) -> str:
    """{yyyy} {mm} {dd} {HH} {MM} {SS} and {date} of a template."""
    out = template.replace("{date}", f"{at:%Y-%m-%d}")
    for key, fmt in (("{yyyy}", "%Y"), ("{mm}", "%m"), ("{dd}", "%d"), ("{HH}", "%H"), ("{MM}", "%M"), ("{SS}", "%S")):
        out = out.replace(key, at.strftime(fmt))
    return out


def date_paths(template: str, start, end) -> list[str]:
    """The template's path at each hour from start to end, once each; reversed ends swap.
    A date without a time means its whole day."""
    a, b = as_datetime(start), as_datetime(end)
    whole_day = not isinstance(end, datetime.datetime) and not re.search(r"[T ]\d", str(end))
    if a > b:
        a, b = b, a
    if whole_day:
        b = b.replace(hour=23)
    hours = int((b - a).total_seconds() // 3600)
    return list(dict.fromkeys(fill(template, a + datetime.timedelta(hours=h)) for h in range(hours + 1)))


def sanitize(value) -> str:
    """A value as part of a path."""
    return re.sub(r"[^A-Za-z0-9_.@-]", "_", str(value))


def bare(uri: str) -> str:
    """A local file's path without its scheme."""
    return "/" + uri.removeprefix("file:").lstrip("/") if uri.startswith(("file:", "/")) else uri
