"""Repository addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, safe_path_part, strip, strip_slashes

# Hosts whose SSH service speaks for the main host, and the messages.
SSH_HOSTS = ("ssh.github.com", "altssh.github.com")
MAIN_HOST = "github.com"
REPO_REQUIRED = "src_repo is required"
REPO_HOST_REQUIRED = "src_repo host is required"
REPO_BAD_PATH = "src_repo must point to a GitHub-style owner/repo path"
REPO_BAD_URL = "invalid src_repo URL: "

_URL = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)"


def normalize_repo_url(raw: Column) -> Column:
    """STRUCT(host, owner, repo, url, error): ``host/owner/repo`` from a URL, ``user@host:path`` or ``host/owner/repo``.

    The host is lower-cased, outer slashes and one ``.git`` are dropped, and the
    SSH hosts become the main host, with a leading ``443`` segment removed.
    """
    return let(strip(raw), lambda text: let(_host_and_path(text), _owner_and_repo))


def _host_and_path(text: Column) -> Column:
    """STRUCT(host, path, error) of a trimmed address in one of the three forms."""
    is_url = text.contains("://")
    after_at = F.regexp_replace(text, "^.*@", "")
    is_scp = text.contains("@") & after_at.contains(":")
    bare = strip_slashes(text)
    is_bare = F.size(F.split(bare, "/")) >= 3
    authority = F.regexp_replace(F.regexp_extract(text, _URL, 2), "^.*@", "")
    url_host = F.when(authority.startswith("["), F.regexp_extract(authority, r"^\[([^\]]*)\]", 1)).otherwise(
        F.regexp_replace(authority, ":[0-9]*$", "")
    )
    host = (
        F.when(is_url, url_host)
        .when(is_scp, F.substring_index(after_at, ":", 1))
        .when(is_bare, F.substring_index(bare, "/", 1))
    )
    path = (
        F.when(is_url, F.regexp_extract(text, _URL, 3))
        .when(is_scp, F.regexp_replace(after_at, "^[^:]*:", ""))
        .when(is_bare, F.regexp_replace(bare, "^[^/]*/", ""))
    )
    bad_url = F.concat(F.lit(REPO_BAD_URL), text)
    error = (
        F.when(F.coalesce(text, F.lit("")) == "", F.lit(REPO_REQUIRED))
        .when(is_url & ~text.rlike(_URL), bad_url)
        .when(is_url & (authority == ""), F.lit(REPO_HOST_REQUIRED))
        .when(~is_url & ~is_scp & ~is_bare, bad_url)
    )
    return F.struct(F.lower(strip(host)).alias("host"), path.alias("path"), error.alias("error"))


def _owner_and_repo(address: Column) -> Column:
    """STRUCT(host, owner, repo, url, error) of a host and path."""
    via_ssh = address["host"].isin(*SSH_HOSTS)
    host = F.when(via_ssh, F.lit(MAIN_HOST)).otherwise(address["host"])
    named = F.regexp_replace(strip_slashes(address["path"]), r"\.git$", "")
    port_first = via_ssh & named.rlike("^443/[^/]*/[^/]*$")
    named = F.when(port_first, F.regexp_replace(named, "^443/", "")).otherwise(named)
    error = F.coalesce(
        address["error"], F.when(~F.coalesce(named.rlike("^[^/]+/[^/]+$"), F.lit(False)), F.lit(REPO_BAD_PATH))
    )
    return let(
        F.struct(host.alias("host"), named.alias("named"), error.alias("error")),
        lambda a: F.struct(
            *[
                F.when(a["error"].isNull(), value).alias(name)
                for name, value in (
                    ("host", a["host"]),
                    ("owner", F.substring_index(a["named"], "/", 1)),
                    ("repo", F.substring_index(a["named"], "/", -1)),
                    ("url", F.concat_ws("/", a["host"], a["named"])),
                )
            ],
            a["error"].alias("error"),
        ),
    )


def repo_identity(raw: Column) -> Column:
    """STRUCT(host, owner, repo, url, error) of a repository address; url is the web address."""
    return let(
        normalize_repo_url(raw),
        lambda a: F.struct(a["host"], a["owner"], a["repo"], F.concat(F.lit("https://"), a["url"]).alias("url"), a["error"]),
    )


def requested_repo_url(full_name: Column) -> Column:
    """Address for a request that may be just ``owner/name``."""
    text = strip(full_name)
    return F.when(text.rlike("^(https?://|git@)"), text).otherwise(F.concat(F.lit("https://github.com/"), text))


def mirror_path(host: Column, owner: Column, repo: Column, data_dir: str) -> Column:
    return F.concat_ws(
        "/",
        F.lit(data_dir.rstrip("/")),
        safe_path_part(host),
        safe_path_part(owner),
        F.concat(safe_path_part(repo), F.lit(".git")),
    )
