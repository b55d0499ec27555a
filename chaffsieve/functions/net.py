"""Lists, ports, hosts and origins as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chaffsieve.functions.text import WS, trimmed

_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
LOOPBACK = rf"^(localhost|::1|127(\.{_OCTET}){{3}})\z"
#: A host name, or an address in brackets: no delimiter of a URL, no blank.
HOST = r"(?:\[[0-9A-Fa-f:.]+\]|[^\x00-\x20#%/:<>?@\[\\\]^|\x7F]+)"
#: Schemes with an origin, and their default ports.
SCHEMES = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21}


def delimited(c: Column) -> Column:
    """The entries of a list parted by commas and blanks; null and blanks have none."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), rf"[{WS},]+"), lambda x: x != "")


def is_loopback(c: Column) -> Column:
    return F.coalesce(c.rlike(LOOPBACK), F.lit(False))


def port(c: Column) -> Column:
    """A whole number from 1 to 65535, else null."""
    digits = F.regexp_extract(trimmed(c), r"^0*([0-9]{1,5})\z", 1)
    n = F.when(digits != "", digits).cast("int")
    return F.when(n.between(1, 65535), n)


def _port_fits(digits: Column) -> Column:
    return F.coalesce(F.regexp_replace(digits, "^0+", "").rlike(r"^([0-9]{0,4}|[1-5][0-9]{4}|6[0-4][0-9]{3}|65[0-4][0-9]{2}|655[0-2][0-9]|6553[0-5])\z"), F.lit(False))


def host(c: Column) -> Column:
    """The lower-case host of "host[:port]" without brackets; null for anything else."""
    shape = rf"^({HOST})(?::([0-9]*))?\??#?\z"
    v = trimmed(c)
    fit = v.rlike(shape) & _port_fits(F.regexp_extract(v, shape, 2))
    return F.when(fit, F.lower(F.regexp_replace(F.regexp_extract(v, shape, 1), r"[\[\]]", "")))


def origin(c: Column) -> Column:
    """scheme://host[:port] in lower case, without the scheme's default port and without user, path and query; null for
    what has no origin."""
    shape = rf"^(?i)({'|'.join(SCHEMES)})://(?:[^/?#@\\]*@)?({HOST})(?::([0-9]*))?(?:[/?#\\][\s\S]*)?\z"
    v = trimmed(c)
    scheme, name = F.lower(F.regexp_extract(v, shape, 1)), F.lower(F.regexp_extract(v, shape, 2))
    digits = F.regexp_extract(v, shape, 3)
    number = F.regexp_replace(digits, "^0+(?=[0-9])", "")
    usual = F.lit(None)
    for known, n in SCHEMES.items():
        usual = F.when(scheme == known, F.lit(str(n))).otherwise(usual)
    tail = F.when((number == "") | (number == usual), F.lit("")).otherwise(F.concat(F.lit(":"), number))
    return F.when(v.rlike(shape) & _port_fits(digits), F.concat(scheme, F.lit("://"), name, tail))
