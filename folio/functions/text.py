"""Expressions over file contents and the text forms of numbers."""

from __future__ import annotations

from folio.functions import case, quoted

# Word pieces and punctuation pieces; the classes are spelled out because \w is ASCII only.
PIECES = r"[\p{L}\p{M}\p{N}\p{Pc}]+|[^\p{L}\p{M}\p{N}\p{Pc}\s]+"
CONTROL_BYTES = r"[\x00-\x08\x0E-\x1F]"
XML_FORBIDDEN = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]"


def _removed(text: str, needle: str) -> str:
    """Bytes that the occurrences of `needle` take up."""
    return f"(octet_length({text}) - octet_length(replace({text}, {quoted(needle)}, '')))"


def _open_ended(text: str) -> str:
    """1 when the last line has no newline, else 0."""
    return f"if({text} <> '' AND NOT endswith({text}, '\\n'), 1, 0)"


def line_count(text: str) -> str:
    """Lines; a final newline does not start another one."""
    newline = "\n"
    return f"cast({_removed(text, newline)} + {_open_ended(text)} AS BIGINT)"


def char_count(text: str) -> str:
    """Code points without line ends, plus one per line."""
    pairs = f"{_removed(text, chr(13) + chr(10))} div 2"
    return f"cast(length({text}) - {pairs} + {_open_ended(text)} AS BIGINT)"


def token_estimate(chars: str) -> str:
    return f"({chars} div 4)"


def piece_count(text: str) -> str:
    return f"cast(regexp_count({text}, {quoted(PIECES)}) AS BIGINT)"


def content_hash(text: str) -> str:
    return f"sha2({text}, 256)"


def looks_like_text(
    raw: str, size: str, text_limit: int, sample_bytes: int, trim_partial_char: bool
) -> str:
    """Non-empty, below the limit, valid UTF-8 head with under a tenth of control bytes."""

    def head(length: int) -> str:
        return f"cast(substring({raw}, 1, {length}) AS STRING)"

    valid = [f"is_valid_utf8({head(sample_bytes)})"]
    if trim_partial_char:
        valid += [
            f"({size} > {sample_bytes} AND is_valid_utf8({head(sample_bytes - cut)}))"
            for cut in (1, 2, 3)
        ]
    controls = f"regexp_count({head(sample_bytes)}, {quoted(CONTROL_BYTES)})"
    return (
        f"({size} > 0 AND {size} < {text_limit} AND ({' OR '.join(valid)}) "
        f"AND {controls} * 10 < octet_length({head(sample_bytes)}))"
    )


def size_text(size: str) -> str:
    """Bytes, or KB/MB/GB with two decimals.

    The units are powers of two, so rounding half to even on whole numbers gives the same
    digits as printing the exact quotient.
    """

    def scaled(unit: int, label: str) -> str:
        down = f"({size} * 100 div {unit})"
        rest = f"({size} * 100 % {unit}) * 2"
        up = f"if({rest} > {unit} OR ({rest} = {unit} AND {down} % 2 = 1), 1, 0)"
        digits = f"({down} + {up})"
        return f"concat({digits} div 100, '.', lpad({digits} % 100, 2, '0'), ' {label}')"

    return case(
        (f"{size} >= {1 << 30}", scaled(1 << 30, "GB")),
        (f"{size} >= {1 << 20}", scaled(1 << 20, "MB")),
        (f"{size} >= {1 << 10}", scaled(1 << 10, "KB")),
        otherwise=f"concat({size}, ' bytes')",
    )


def one_decimal(value: str) -> str:
    """One decimal of the exact binary value, ties to even."""
    return f"replace(format_number({value}, 1), ',', '')"


def count_text(count: str) -> str:
    """Plain below a thousand, else K or M with one decimal."""
    number = f"cast({count} AS DOUBLE)"
    return case(
        (f"{count} >= 1000000", f"concat({one_decimal(f'{number} / 1000000D')}, 'M')"),
        (f"{count} >= 1000", f"concat({one_decimal(f'{number} / 1000D')}, 'K')"),
        otherwise=f"cast({count} AS STRING)",
    )


def xml_clean(text: str) -> str:
    """Characters that XML 1.0 forbids become U+FFFD."""
    return f"regexp_replace({text}, {quoted(XML_FORBIDDEN)}, '�')"


def xml_escape(text: str) -> str:
    escaped = xml_clean(text)
    # The five predefined entities, ampersand first.
    for char, entity in (
        ("&", "&amp;"),
        ("<", "&lt;"),
        (">", "&gt;"),
        ("'", "&apos;"),
        ('"', "&quot;"),
    ):
        escaped = f"replace({escaped}, {quoted(char)}, '{entity}')"
    return escaped


def cdata(text: str) -> str:
    """CDATA section; a section end inside the text is split over two sections."""
    split = f"replace({xml_clean(text)}, ']]>', ']]]]><![CDATA[>')"
    return f"concat('<![CDATA[', {split}, ']]>')"


def rfc3339(moment: str) -> str:
    """UTC text of a timestamp, whatever the session time zone; zero fractions are left out."""
    micros = f"unix_micros({moment})"
    day = f"date_from_unix_date(cast(floor({micros} / 86400000000) AS INT))"
    second = f"(pmod({micros}, 86400000000) div 1000000)"
    fraction = f"lpad(pmod({micros}, 1000000), 6, '0')"
    clock = ", ':', ".join(
        f"lpad({value}, 2, '0')"
        for value in (f"{second} div 3600", f"{second} div 60 % 60", f"{second} % 60")
    )
    decimals = case(
        (f"pmod({micros}, 1000000) = 0", "''"),
        (f"pmod({micros}, 1000) = 0", f"concat('.', left({fraction}, 3))"),
        otherwise=f"concat('.', {fraction})",
    )
    return f"concat({day}, 'T', {clock}, {decimals}, '+00:00')"
