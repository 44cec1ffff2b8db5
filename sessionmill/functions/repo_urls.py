"""Credential-free repository identity out of git remotes and git config texts.

Written from git's documentation: a remote is a URL `scheme://[user@]host[:port]/path` or the short form
`[user@]host:path`, which has no slash before its first colon. A config is made of sections headed by
`[name]` or `[name "subsection"]`; names and keys ignore case, subsections do not; `#` and `;` begin comments.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sessionmill.functions.text import trim_blank

SHA_PATTERN = "^[0-9a-f]{40}$"
# Ports that are their scheme's own and are left out.
_OWN_PORTS = ["http:80", "https:443", "ftp:21", "ws:80", "wss:443"]


def _after(text: Column, mark: str) -> Column:
    """What follows the first mark; empty without one."""
    at = F.locate(mark, text)
    return F.when(at > 0, F.substr(text, at + F.lit(len(mark)))).otherwise(F.lit(""))


def remote_identity(url: Column) -> Column:
    """STRUCT<host, owner, name> of a git remote, null unless every part is clean."""
    u = trim_blank(url)
    is_url = F.contains(u, F.lit("://"))
    rest = _after(u, "://")
    scheme = F.lower(F.substring_index(u, "://", 1))
    whole_host = F.substring_index(F.regexp_substr(rest, F.lit("^[^/?#]*")), "@", -1)
    number = _after(whole_host, ":")
    own = F.concat_ws(":", scheme, number).isin(_OWN_PORTS)
    url_host = F.when(own | (number == ""), F.substring_index(whole_host, ":", 1)).otherwise(whole_host)
    url_path = F.regexp_replace(F.regexp_substr(rest, F.lit("/[^?#]*")), " ", "%20")
    before = F.substring_index(u, ":", 1)
    short = F.contains(u, F.lit(":")) & ~F.contains(before, F.lit("/"))
    short_host = F.when(short, F.regexp_replace(before, "^[^@]+@", ""))

    host = F.lower(F.when(is_url & scheme.rlike("^[a-z][a-z0-9+.-]*$"), url_host).when(~is_url, short_host))
    path = F.when(is_url, url_path).otherwise(_after(u, ":"))
    names = F.array_remove(F.split(F.regexp_replace(path, "[.]git$", ""), "/", -1), "")
    owner, name = F.try_element_at(names, F.lit(-2)), F.try_element_at(names, F.lit(-1))
    clean = F.forall(F.array(owner, name), lambda part: ~part.rlike(r"[\s@]"))
    good_host = host.rlike("^[a-z0-9.-]+(?::[0-9]{1,5})?$")
    return F.when(
        good_host & (F.size(names) > 1) & clean,
        F.struct(host.alias("host"), owner.alias("owner"), name.alias("name")),
    )


def origin_url(config: Column) -> Column:
    """URL of the remote called origin in a git config text; null when there is none.

    The text is cut where a line opens a section, and the url is looked up in those headed for origin.
    """
    sections = F.split(F.concat(F.lit("\n"), config), r"\n[ \t]*\[", -1)
    origin = F.filter(sections, lambda s: s.rlike(r'^\s*(?i:remote)\s+"origin"\s*\]'))
    keys = F.flatten(F.transform(origin, lambda s: F.regexp_extract_all(s, F.lit(r"(?im)^[ \t]*url[ \t]*=(.*)$"), F.lit(1))))
    plain = F.transform(keys, lambda v: trim_blank(F.regexp_replace(v, r"(?:^|\s)[#;].*$", "")))
    named = F.filter(F.transform(plain, lambda v: F.regexp_replace(v, '^"(.*)"$', "$1")), lambda v: v != "")
    return F.get(named, F.lit(0))
