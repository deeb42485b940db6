"""Credential files recognised by name alone."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlens.functions.events import any_of
from fleetlens.functions.paths import basename, clean_path, extension

# Words that mark a template, and source code extensions.
TEMPLATE_WORDS = (
    "example", "examples", "sample", "samples", "template", "templates", "dist", "tpl",
    "defaults", "dummy", "fake", "mock", "fixture", "fixtures", "test", "tests", "testing",
)
CODE_EXTENSIONS = (
    ".go", ".rs", ".py", ".js", ".ts", ".java", ".rb", ".c", ".h", ".cpp", ".cs", ".php",
    ".md", ".txt",
)


def is_template_name(base: Column) -> Column:
    """Whole words only: ``.env.latest`` is live although it contains ``test``."""
    return F.arrays_overlap(
        F.split(base, r"[._-]"), F.array(*[F.lit(w) for w in TEMPLATE_WORDS])
    )


def is_code_extension(ext: Column) -> Column:
    return ext.isin(*CODE_EXTENSIONS)


def classify_secret_path(path: Column) -> Column:
    """One of eight classes, '' when the name is not credential-shaped."""
    p = F.lower(clean_path(F.translate(path, "\\", "/")))
    base = basename(p)
    ext = extension(p)
    service_account = (
        base.startswith("service-account")
        | base.startswith("serviceaccount")
        | base.startswith("client_secret")
    ) & (ext == ".json")
    return (
        F.when(is_template_name(base), "")
        .when((base == ".env") | base.startswith(".env.") | base.endswith(".env"), "dotenv")
        .when(base.isin("id_rsa", "id_dsa", "id_ecdsa", "id_ed25519"), "private-key")
        .when(ext.isin(".pem", ".key", ".ppk"), "private-key")
        .when(ext.isin(".p12", ".pfx", ".jks", ".keystore"), "keystore")
        .when(
            base.isin("credentials.json", "client_secret.json")
            | service_account
            | p.endswith(".aws/credentials")
            | p.endswith(".gcp/credentials.json"),
            "cloud-credential",
        )
        .when(
            base.isin(".npmrc", ".pypirc", ".netrc", "_netrc") | p.endswith(".gem/credentials"),
            "package-registry",
        )
        .when(
            (base == "terraform.tfvars")
            | base.endswith(".auto.tfvars")
            | (ext == ".tfstate")
            | base.endswith(".tfstate.backup"),
            "iac-secret",
        )
        .when(
            (base == "kubeconfig") | (ext == ".kubeconfig") | p.endswith(".kube/config"),
            "kubeconfig",
        )
        .when(base.isin(".htpasswd", "htpasswd"), "generic-secret")
        .when(base.contains("secret") & ~is_code_extension(ext), "generic-secret")
        .otherwise("")
    )


def jvm_regex(pattern: str) -> str:
    """Path patterns are written for RE2; the JVM differs in ``$`` and ``\\s``."""
    pattern = re.sub(r"(?<!\\)\$", r"\\z", pattern)
    return re.sub(r"(?<!\\)\\s", r"[\\t\\n\\f\\r ]", pattern)


def matches_any(path: Column, patterns: tuple[str, ...]) -> Column:
    if not patterns:
        return F.lit(False)
    return any_of([path.rlike(jvm_regex(p)) for p in patterns])
