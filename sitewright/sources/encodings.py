"""Character encodings as the web knows them: labels, and decoders that read what servers send under them."""

from __future__ import annotations

import codecs


def _iso(n: int, registered: int, year: int, more: str = "") -> str:
    return f"iso-8859-{n} iso-ir-{registered} iso8859-{n} iso8859{n} iso_8859-{n} iso_8859-{n}:{year} {more}"


def _windows(n: int, more: str = "") -> str:
    return f"windows-{n} cp{n} x-cp{n} {more}"


#: Each encoding's codec and labels (from the Encoding standard). Several labels mean more than they say: what is
#: sent as gb2312 may hold all of gb18030, shift_jis all of Windows-31J, and Latin-1 or ASCII Windows-1252.
ENCODINGS = {
    "utf-8": ("utf-8", "utf-8 utf8 unicode-1-1-utf-8 unicode11utf8 unicode20utf8 x-unicode20utf8"),
    "ibm866": ("cp866", "866 cp866 csibm866 ibm866"),
    "iso-8859-2": ("iso8859-2", _iso(2, 101, 1987, "csisolatin2 l2 latin2")),
    "iso-8859-3": ("iso8859-3", _iso(3, 109, 1988, "csisolatin3 l3 latin3")),
    "iso-8859-4": ("iso8859-4", _iso(4, 110, 1988, "csisolatin4 l4 latin4")),
    "iso-8859-5": ("iso8859-5", _iso(5, 144, 1988, "csisolatincyrillic cyrillic")),
    "iso-8859-6": ("iso8859-6", _iso(6, 127, 1987, "arabic asmo-708 csiso88596e csiso88596i csisolatinarabic ecma-114 iso-8859-6-e iso-8859-6-i")),
    "iso-8859-7": ("iso8859-7", _iso(7, 126, 1987, "csisolatingreek ecma-118 elot_928 greek greek8 sun_eu_greek")),
    "iso-8859-8": ("iso8859-8", _iso(8, 138, 1988, "csiso88598e csisolatinhebrew hebrew iso-8859-8-e visual")),
    "iso-8859-8-i": ("iso8859-8", "csiso88598i iso-8859-8-i logical"),
    "iso-8859-10": ("iso8859-10", _iso(10, 157, 1992, "csisolatin6 l6 latin6")),
    "iso-8859-13": ("iso8859-13", "iso-8859-13 iso8859-13 iso885913"),
    "iso-8859-14": ("iso8859-14", "iso-8859-14 iso8859-14 iso885914"),
    "iso-8859-15": ("iso8859-15", "csisolatin9 iso-8859-15 iso8859-15 iso885915 iso_8859-15 l9"),
    "iso-8859-16": ("iso8859-16", "iso-8859-16"),
    "koi8-r": ("koi8-r", "cskoi8r koi koi8 koi8-r koi8_r"),
    "koi8-u": ("koi8-u", "koi8-ru koi8-u"),
    "macintosh": ("mac-roman", "csmacintosh mac macintosh x-mac-roman"),
    "windows-874": ("cp874", "dos-874 iso-8859-11 iso8859-11 iso885911 tis-620 windows-874"),
    "windows-1250": ("cp1250", _windows(1250)),
    "windows-1251": ("cp1251", _windows(1251)),
    "windows-1252": ("cp1252", _windows(1252, _iso(1, 100, 1987, "ansi_x3.4-1968 ascii cp819 csisolatin1 ibm819 l1 latin1 us-ascii"))),
    "windows-1253": ("cp1253", _windows(1253)),
    "windows-1254": ("cp1254", _windows(1254, _iso(9, 148, 1989, "csisolatin5 l5 latin5"))),
    "windows-1255": ("cp1255", _windows(1255)),
    "windows-1256": ("cp1256", _windows(1256)),
    "windows-1257": ("cp1257", _windows(1257)),
    "windows-1258": ("cp1258", _windows(1258)),
    "x-mac-cyrillic": ("mac-cyrillic", "x-mac-cyrillic x-mac-ukrainian"),
    "gbk": ("gb18030", "chinese csgb2312 csiso58gb231280 gb2312 gb_2312 gb_2312-80 gbk iso-ir-58 x-gbk"),
    "gb18030": ("gb18030", "gb18030"),
    "big5": ("big5hkscs", "big5 big5-hkscs cn-big5 csbig5 x-x-big5"),
    "euc-jp": ("euc-jp", "cseucpkdfmtjapanese euc-jp x-euc-jp"),
    "iso-2022-jp": ("iso2022-jp", "csiso2022jp iso-2022-jp"),
    "shift_jis": ("cp932", "csshiftjis ms932 ms_kanji shift-jis shift_jis sjis windows-31j x-sjis"),
    "euc-kr": ("cp949", "cseuckr csksc56011987 euc-kr iso-ir-149 korean ks_c_5601-1987 ks_c_5601-1989 ksc5601 ksc_5601 windows-949"),
    "utf-16be": ("utf-16-be", "unicodefffe utf-16be"),
    "utf-16le": ("utf-16-le", "csunicode iso-10646-ucs-2 ucs-2 unicode unicodefeff utf-16 utf-16le"),
    "x-user-defined": ("latin-1", "x-user-defined"),
}
_BY_LABEL = {label: name for name, (_, labels) in ENCODINGS.items() for label in labels.split()}
_PRIVATE = {b: 0xF700 + b for b in range(0x80, 0x100)}


def _unmapped(error: UnicodeError):
    """Bytes 0x80 to 0x9F that a code page leaves open are controls on the web; others, and broken sequences, the replacement character."""
    if not isinstance(error, UnicodeDecodeError):
        raise error
    single = error.end - error.start == 1 and error.encoding.lower().replace("_", "-") in _CODE_PAGES
    byte = error.object[error.start]
    return (chr(byte) if single and 0x80 <= byte <= 0x9F else "�"), error.end


_CODE_PAGES = {"charmap", *(codec for name, (codec, _) in ENCODINGS.items() if name.startswith("windows-"))}
codecs.register_error("sitewright-web", _unmapped)


def encoding(label: str | None) -> str | None:
    """The encoding that a label means, without case and outer blanks; null for what is none on the web."""
    return _BY_LABEL.get((label or "").strip(" \t\n\f\r").lower())


def decoded(body: bytes, name: str) -> str:
    """The text of a body; a byte order mark of its own encoding goes."""
    text = body.decode(ENCODINGS[name][0], "sitewright-web")
    if name == "x-user-defined":
        return text.translate(_PRIVATE)
    return text.removeprefix("﻿") if name.startswith("utf-") else text
