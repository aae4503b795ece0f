"""Expressions that recognise and take apart repository URLs."""

from __future__ import annotations

from folio.functions import case, quoted

# The two accepted shapes, and hosts with a storage folder of their own.
HTTP_SHAPE = r"\Ahttps?://.*/[^/]+/[^/]+\z"
SSH_SHAPE = r"\Agit@([^:]+):([^/]+)/([^/]+)\z"
HTTP_PARTS = r"\Ahttps?://([^/?#]+)/([^?#]*)"
KNOWN_HOSTS = {"github.com": "github", "gitlab.com": "gitlab", "bitbucket.org": "bitbucket"}
HOST_TITLES = {"github": "GitHub", "gitlab": "GitLab", "bitbucket": "Bitbucket"}
STORAGE_KINDS = ("github", "gitlab", "bitbucket", "git")


def host_kind(host: str) -> str:
    known = [(f"{host} = '{name}'", f"'{kind}'") for name, kind in KNOWN_HOSTS.items()]
    return case((f"{host} IS NULL", "NULL"), *known, otherwise="'git'")


def storage_path(kind: str, host: str, owner: str, name: str) -> str:
    return f"concat_ws('/', {kind}, if({kind} = 'git', {host}, NULL), {owner}, {name})"


def host_title(kind: str, host: str) -> str:
    titles = [(f"{kind} = '{label}'", f"'{title}'") for label, title in HOST_TITLES.items()]
    return case(*titles, otherwise=host)


def repo_display(kind: str, host: str, owner: str, name: str) -> str:
    return f"concat_ws('/', {host_title(kind, host)}, {owner}, {name})"


def parse_repo_url(url: str) -> str:
    """Struct of host, owner and name; NULL when the text is not a repository URL."""
    authority = f"regexp_extract({url}, {quoted(HTTP_PARTS)}, 1)"
    http_host = f"lower(regexp_replace({authority}, '^.*@|:[0-9]*$', ''))"
    segments = f"split(regexp_extract({url}, {quoted(HTTP_PARTS)}, 2), '/')"
    is_http = f"{url} RLIKE {quoted(HTTP_SHAPE)} AND {http_host} <> '' AND size({segments}) >= 2"

    def parsed(host: str, owner: str, name: str) -> str:
        bare = f"regexp_replace({name}, {quoted(r'\.git\z')}, '')"
        return f"named_struct('host', {host}, 'owner', {owner}, 'name', {bare})"

    ssh = [f"regexp_extract({url}, {quoted(SSH_SHAPE)}, {group})" for group in (1, 2, 3)]
    return case(
        (is_http, parsed(http_host, f"get({segments}, 0)", f"get({segments}, 1)")),
        (f"{url} RLIKE {quoted(SSH_SHAPE)}", parsed(*ssh)),
    )


def is_repo_url(url: str) -> str:
    return f"({parse_repo_url(url)} IS NOT NULL)"
