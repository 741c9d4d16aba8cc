"""Settings of the operators.  Every class is a plain immutable record."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import timedelta

# Default limits.
MAX_BODY_BYTES = 10_485_760
MAX_EVENTS_PER_REQUEST = 5_000
MAX_EVENT_BYTES = 262_144
MAX_ATTR_COUNT = 512
MAX_ATTR_DEPTH = 16
MAX_STRING_LENGTH = 16_384

# Member names that are hidden by default.
DEFAULT_BLOCKLIST = (
    "password", "passwd", "secret", "token", "api_key", "apikey", "authorization", "cookie",
    "set-cookie", "private_key", "access_token", "refresh_token", "session",
)

# The default projection of the stored table (column -> path) and its types (by path).
DEFAULT_COLUMNS = {
    "event_id": "event_id",
    "event_type": "event",
    "service": "service",
    "status_code": "http.status",
    "duration_ms": "duration_ms",
    "timestamp": "timestamp",
}
DEFAULT_TYPES = {
    "status_code": "INTEGER",
    "http.status": "INTEGER",
    "duration_ms": "DOUBLE",
    "timestamp": "TIMESTAMP",
}


@dataclass(frozen=True)
class RequestLimits:
    max_body_bytes: int = MAX_BODY_BYTES
    max_events: int = MAX_EVENTS_PER_REQUEST


@dataclass(frozen=True)
class Limits:
    """A value of 0 turns that limit off; ``enabled`` turns all of them off."""

    enabled: bool = True
    max_event_bytes: int = MAX_EVENT_BYTES
    max_attr_count: int = MAX_ATTR_COUNT
    max_attr_depth: int = MAX_ATTR_DEPTH
    max_string_length: int = MAX_STRING_LENGTH


@dataclass(frozen=True)
class Contract:
    enabled: bool = True
    schema_version: str = "v1"
    event_version: str = "v1"


@dataclass(frozen=True)
class Identity:
    enabled: bool = True
    auth_identity_wins: bool = True
    allow_payload_identity: bool = True
    service_name: str = ""
    service_version: str = ""
    environment: str = ""
    region: str = ""
    tenant_id: str = ""
    workspace_id: str = ""
    organization_id: str = ""

    @property
    def stamps(self) -> bool:
        bound = (self.service_name, self.environment, self.region, self.tenant_id, self.workspace_id,
                 self.organization_id)
        return self.enabled and self.auth_identity_wins and not self.allow_payload_identity and any(bound)


@dataclass(frozen=True)
class Privacy:
    """``blocklist``/``secret_scan`` drive both redaction steps; ``allowlist`` only the second one."""

    mode: str = "warn"
    collector_redaction: bool = True
    emergency_redaction: bool = False
    blocklist: tuple[str, ...] = DEFAULT_BLOCKLIST
    allowlist: tuple[str, ...] = ()
    secret_scan: bool = True

    @property
    def collector_active(self) -> bool:
        switched_on = self.collector_redaction or self.emergency_redaction
        return self.mode.strip().lower() != "off" and switched_on and bool(self.blocklist or self.secret_scan)

    @property
    def processor_active(self) -> bool:
        return self.mode != "" and self.mode.lower() != "off"


@dataclass(frozen=True)
class RegistryEntry:
    schema_version: str
    event_version: str
    required_fields: tuple[str, ...] = ()


# Fixed value: the default registry entry.
DEFAULT_REGISTRY = (
    RegistryEntry("v1", "v1", ("schema_version", "event_version", "event_id", "event", "timestamp")),
)


@dataclass(frozen=True)
class SchemaRules:
    mode: str = "off"  # off, warn, reject, enforce or quarantine
    schema_version: str = "v1"
    event_version: str = "v1"


@dataclass(frozen=True)
class DedupeRules:
    enabled: bool = False
    key: str = "event_id"
    window: timedelta = timedelta(hours=24)


@dataclass(frozen=True)
class DeliveryRules:
    policy: str = "require_primary"  # or best_effort, require_all
    fallback_enabled: bool = False
    fallback_on_primary: bool = False
    fallback_on_secondary: bool = False
    fallback_on_policy: bool = True
    dlq_enabled: bool = False
    dlq_on_primary: bool = True
    dlq_on_secondary: bool = False
    dlq_on_fallback: bool = True
    dlq_on_policy: bool = True


@dataclass(frozen=True)
class RetryRules:
    enabled: bool = True
    max_attempts: int = 10
    initial_backoff: float = 0.1
    max_backoff: float = 30.0
    jitter: bool = True


@dataclass(frozen=True)
class Settings:
    """``validate_objects`` off lets events pass that are no JSON object; ``privacy.mode`` then says what becomes of them."""

    validate_objects: bool = True
    requests: RequestLimits = field(default_factory=RequestLimits)
    limits: Limits = field(default_factory=Limits)
    contract: Contract = field(default_factory=Contract)
    identity: Identity = field(default_factory=Identity)
    privacy: Privacy = field(default_factory=Privacy)
    schema: SchemaRules = field(default_factory=SchemaRules)
    dedupe: DedupeRules = field(default_factory=DedupeRules)
    delivery: DeliveryRules = field(default_factory=DeliveryRules)
    retry: RetryRules = field(default_factory=RetryRules)
