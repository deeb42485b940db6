"""Indicators the jobs look for. Every operator takes them from an ``IndicatorSpec``."""

from __future__ import annotations

from dataclasses import dataclass, field

UNATTRIBUTED = "<unattributed>"

# Names and limits of the evidence format. They must equal what
# the collector on the hosts writes.
_BUCKET = "grok-code-session-traces"
_EVENT_PREFIX = "repo_state.upload"
_MITIGATION_FLAG = "disable_codebase_upload"
_BEFORE_ARCHIVE = "before_codebase.tar.gz"
_ENDPOINT = "cli-chat-proxy.grok.com"

_SUCCESS_SUFFIXES = (
    ".completed", ".complete", ".done", ".success", ".succeeded",
    ".finished", ".uploaded", ".delivered", ".ok",
)

_FIELD_ALIASES = {
    "event": ("event", "event_name", "name", "type", "msg", "message", "evt"),
    "sid": ("sid", "session_id", "ctx.sid", "ctx.session_id", "session"),
    "turn": ("ctx.turn_number", "turn_number", "ctx.turn", "turn", "ctx.turn_id"),
    "repo": ("ctx.repo_path", "repo_path", "ctx.repo", "repo", "ctx.cwd", "cwd",
             "ctx.workspace", "workspace"),
    "gcs_path": ("gcs_path", "gcsPath", "ctx.gcs_path", "destination", "dest",
                 "object_path", "path"),
    "time": ("ts", "time", "timestamp", "@timestamp", "ctx.ts", "datetime"),
    "version": ("version", "ctx.version", "app_version", "cli_version",
                "ctx.app_version", "ver", "ctx.ver"),
    "consumer": ("ctx.consumer", "consumer", "ctx.client", "client", "ctx.caller", "caller"),
    "status": ("status", "status_code", "code", "http_status", "response_code",
               "ctx.status", "ctx.status_code", "ctx.code", "ctx.http_status",
               "ctx.response_code"),
}


@dataclass(frozen=True)
class Mitigation:
    table: str
    key: str
    want: str
    what: str

    @property
    def locator(self) -> str:
        return f"{self.table}.{self.key}"


@dataclass(frozen=True)
class IndicatorSpec:
    bucket: str = _BUCKET
    event_prefix: str = _EVENT_PREFIX
    success_suffixes: tuple[str, ...] = _SUCCESS_SUFFIXES
    upload_leg_words: tuple[str, ...] = ("upload", "storage")
    auth_code: str = "401"
    archive_suffix: str = "codebase.tar.gz"
    queue_archive_suffixes: tuple[str, ...] = (".tar.gz", ".tgz")
    before_prefix: str = "before_codebase"
    after_prefix: str = "after_codebase"
    aliases: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(_FIELD_ALIASES))
    markers: tuple[str, ...] = (
        _BUCKET, _EVENT_PREFIX, _MITIGATION_FLAG, _BEFORE_ARCHIVE, _ENDPOINT,
    )
    home_dir: str = ".grok"
    queue_dir: str = "upload_queue"
    manifest_name: str = "metadata.json"
    config_name: str = "config.toml"
    auth_name: str = "auth.json"
    command_names: tuple[str, ...] = ("grok", "grok.exe")
    product_word: str = "grok"
    package_words: tuple[str, ...] = ("grok-cli", "grok-build")
    version_files: tuple[str, ...] = (
        "version", "VERSION", ".version", "install.json", "manifest.json", "package.json",
    )
    confirmed_version: tuple[int, int, int] = (0, 2, 93)
    reported_max: tuple[int, int, int] = (0, 2, 99)
    mitigations: tuple[Mitigation, ...] = (
        Mitigation("harness", _MITIGATION_FLAG, "true", "whole-repository archive upload"),
        Mitigation("telemetry", "trace_upload", "false", "session trace upload"),
    )
    log_prefix: str = "unified"
    log_infix: str = ".jsonl"
    upload_grace: str = "INTERVAL 1 HOUR"
    # From these lengths on, JSON that cannot be parsed is an error row; texts are read whole.
    max_manifest_bytes: int = 4 << 20
    max_version_file_bytes: int = 1 << 20
    max_config_bytes: int = 1 << 20
    # None: every blob whose content was delivered is scanned whole.
    max_blob_bytes: int | None = None
    # Candidates over this size are delivered in pieces; all sizes are searched.
    max_candidate_bytes: int = 512 << 20
    # The size from which a script counts as a bundle: a definition, not a limit.
    bundle_min_bytes: int = 512 << 10

    @property
    def event_start(self) -> str:
        return self.event_prefix + ".start"

    @property
    def event_enqueued(self) -> str:
        return self.event_prefix + ".enqueued"

    @property
    def success_events(self) -> tuple[str, ...]:
        return tuple(self.event_prefix + s for s in self.success_suffixes)

    @property
    def bucket_url(self) -> str:
        return f"gs://{self.bucket}/"


DEFAULT_SPEC = IndicatorSpec()

SEVERITIES = ("info", "low", "medium", "high", "critical")
SEVERITY_RANK = {name: rank for rank, name in enumerate(SEVERITIES)}
