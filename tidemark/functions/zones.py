"""Time zones as fixed offsets from UTC; daylight saving is never applied."""

from __future__ import annotations

import re

# The supported zone names by their offset.
ZONES_BY_OFFSET = {
    "-12:00": "Etc/GMT+12",
    "-11:00": "Etc/GMT+11",
    "-10:00": "Pacific/Honolulu",
    "-09:00": "America/Anchorage",
    "-08:00": "America/Santa_Isabel America/Los_Angeles",
    "-07:00": "America/Chihuahua America/Phoenix America/Denver",
    "-06:00": "America/Guatemala America/Chicago America/Regina America/Mexico_City",
    "-05:00": "America/Bogota America/Indiana/Indianapolis America/New_York",
    "-04:30": "America/Caracas",
    "-04:00": "America/Halifax America/Asuncion America/La_Paz America/Cuiaba America/Santiago",
    "-03:30": "America/St_Johns",
    "-03:00": "America/Sao_Paulo America/Godthab America/Cayenne America/Argentina/Buenos_Aires America/Montevideo",
    "-02:00": "Etc/GMT+2",
    "-01:00": "Atlantic/Cape_Verde Atlantic/Azores",
    "+00:00": "Africa/Casablanca Atlantic/Reykjavik Europe/London Etc/GMT",
    "+01:00": "Europe/Berlin Europe/Paris Africa/Lagos Europe/Budapest Europe/Warsaw Africa/Windhoek",
    "+02:00": "Europe/Istanbul Europe/Kiev Africa/Cairo Asia/Damascus Asia/Amman Africa/Johannesburg Asia/Jerusalem Asia/Beirut",
    "+03:00": "Asia/Baghdad Europe/Minsk Asia/Riyadh Africa/Nairobi",
    "+03:30": "Asia/Tehran",
    "+04:00": "Europe/Moscow Asia/Tbilisi Asia/Yerevan Asia/Dubai Asia/Baku Indian/Mauritius",
    "+04:30": "Asia/Kabul",
    "+05:00": "Asia/Tashkent Asia/Karachi",
    "+05:30": "Asia/Colombo Asia/Kolkata",
    "+05:45": "Asia/Kathmandu",
    "+06:00": "Asia/Almaty Asia/Dhaka Asia/Yekaterinburg",
    "+06:30": "Asia/Yangon",
    "+07:00": "Asia/Bangkok Asia/Novosibirsk",
    "+08:00": "Asia/Krasnoyarsk Asia/Ulaanbaatar Asia/Shanghai Australia/Perth Asia/Singapore Asia/Taipei",
    "+09:00": "Asia/Irkutsk Asia/Seoul Asia/Tokyo",
    "+09:30": "Australia/Darwin Australia/Adelaide",
    "+10:00": "Australia/Hobart Asia/Yakutsk Australia/Brisbane Pacific/Port_Moresby Australia/Sydney",
    "+11:00": "Asia/Vladivostok Pacific/Guadalcanal",
    "+12:00": "Etc/GMT-12 Pacific/Fiji Asia/Magadan Pacific/Auckland",
    "+13:00": "Pacific/Tongatapu Pacific/Apia",
}


def offset_seconds(text: str) -> int:
    """Seconds of ``+H``, ``+HH``, ``+H:MM`` or ``+HH:MM`` (or minus)."""
    m = re.fullmatch(r"([+-])(\d{1,2})(?::([0-5]\d))?", text)
    if not m:
        raise ValueError(f"not an offset: {text}")
    seconds = int(m[2]) * 3600 + int(m[3] or 0) * 60
    return -seconds if m[1] == "-" else seconds


ZONES = {name: offset_seconds(offset) for offset, names in ZONES_BY_OFFSET.items() for name in names.split()}


def zone_offset(name: str) -> int:
    """Offset in seconds of a zone name (exact spelling), ``UTC``, or a numeric offset."""
    if name == "UTC":
        return 0
    if name in ZONES:
        return ZONES[name]
    try:
        return offset_seconds(name)
    except ValueError:
        raise ValueError(f"unknown time zone: {name}") from None


def offset_text(seconds: int) -> str:
    """``Z`` for no offset, else ``+HH:MM``."""
    if not seconds:
        return "Z"
    hours, minutes = divmod(abs(seconds) // 60, 60)
    return f"{'-' if seconds < 0 else '+'}{hours:02}:{minutes:02}"
