"""Handlers by topic prefix: validation, rules and outcome as columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelane.functions.binary import be_uint, le_uint

from .model import AlertLevel


FIRST_BYTE, AMOUNT = "body_first_byte", "body_amount"
# The handlers' names.
DEFAULT_NAME, TEMPERATURE_NAME, PRESSURE_NAME, PAYMENT_NAME, AUDIT_NAME = "DefaultEventHandler", "SensorTemperatureHandler", "SensorPressureHandler", "PaymentEventHandler", "AuditEventHandler"


def with_body_numbers(events: DataFrame) -> DataFrame:
    """events with the two numbers that handlers read from bodies, each decoded once."""
    return events.withColumns({FIRST_BYTE: be_uint(F.col("body"), 1, 1), AMOUNT: le_uint(F.col("body"), 1, 4)})


def none(kind: str) -> Column:
    return F.lit(None).cast(kind)


@dataclass(frozen=True)
class Handler:
    """What is done with the events of a topic. Subclass it, and give columns over the event's columns and the
    numbers of with_body_numbers.

    validate and rules give a reason to drop the event, or null. What passes is handled: failure gives FAIL or DROP
    where that doesn't succeed, else null; level an alert's level, or null; message what the failure, the alert
    or the success says.
    """

    name: str = DEFAULT_NAME

    def validate(self) -> Column:
        return F.when(F.col("topic") == "", "empty topic")

    def rules(self) -> Column:
        return none("string")

    def failure(self) -> Column:
        return none("string")

    def level(self) -> Column:
        return none("int")

    def message(self) -> Column:
        return none("string")


@dataclass(frozen=True)
class Reading(Handler):
    """A sensor whose first byte is its reading, with two alert bounds and, for some, a physical limit."""

    name: str = ""
    kind: str = ""
    bounds: tuple[tuple[int, AlertLevel, str], ...] = ()  # highest first: over it, the level and the message's start
    unit: str = ""
    limit: int | None = None

    def _reading(self) -> Column:
        return F.col(FIRST_BYTE)

    def validate(self) -> Column:
        return F.when(F.length("body") == 0, f"empty body for {self.kind} sensor")

    def rules(self) -> Column:
        return none("string") if self.limit is None else F.when(self._reading() > self.limit, f"{self.kind} out of physical range")

    def level(self) -> Column:
        out = none("int")
        for over, level, _ in reversed(self.bounds):
            out = F.when(self._reading() > over, int(level)).otherwise(out)
        return out

    def message(self) -> Column:
        out = none("string")
        for over, _, start in reversed(self.bounds):
            out = F.when(self._reading() > over, F.concat(F.lit(start), self._reading().cast("string"), F.lit(self.unit))).otherwise(out)
        return out


@dataclass(frozen=True)
class Payment(Handler):
    """A payment whose first four bytes are its amount, little-endian."""

    name: str = PAYMENT_NAME
    limit: int = 1_000_000

    def validate(self) -> Column:
        return F.when(F.length("body") < 4, "payment body too short")

    def rules(self) -> Column:
        amount = F.col(AMOUNT)
        return F.when(amount == 0, "payment amount is zero").when(amount > self.limit, "payment amount exceeds limit")

    def message(self) -> Column:
        return F.concat(F.lit("payment_ok amount="), F.col(AMOUNT).cast("string"))


@dataclass(frozen=True)
class Audit(Handler):
    name: str = AUDIT_NAME

    def validate(self) -> Column:
        return F.when(F.length("body") == 0, "empty audit log body")


# Prefixes, bounds and wording of the default handlers.
TEMPERATURE = Reading(
    TEMPERATURE_NAME, "temperature", ((100, AlertLevel.CRITICAL, "Temperature critical: "), (80, AlertLevel.WARNING, "Temperature warning: ")), "C",
    150
)
PRESSURE = Reading(
    PRESSURE_NAME, "pressure", ((200, AlertLevel.EMERGENCY, "Pressure emergency: "), (150, AlertLevel.WARNING, "Pressure high: ")), " bar"
)


@dataclass
class Registry:
    """Handlers by topic prefix. The exact topic goes first, then its longest prefix; the last one registered counts."""

    handlers: dict[str, Handler] = field(default_factory=dict)
    default: Handler = field(default_factory=Handler)

    def register(self, prefix: str, handler: Handler) -> Registry:
        self.handlers[prefix] = handler
        return self

    def clear(self) -> None:
        self.handlers.clear()

    def number(self) -> Column:
        """The place in listed() of the handler of each event's topic, as one CASE without a join."""
        out = F.lit(0)
        for k, prefix in sorted(enumerate(self.handlers, 1), key=lambda x: (len(x[1]), x[1])):
            fits = F.startswith(F.col("topic"), F.lit(prefix)) if prefix else F.col("topic") == ""
            out = F.when(fits, k).otherwise(out)
        return out

    def listed(self) -> list[Handler]:
        return [self.default, *self.handlers.values()]

    def choose(self, of, number: Column | None = None) -> Column:
        """The column that `of` gives for the handler of each event's topic, or of the number given."""
        number = self.number() if number is None else number
        out = of(self.default)
        for k, h in enumerate(self.listed()[1:], 1):
            out = F.when(number == k, of(h)).otherwise(out)
        return out


def default_registry() -> Registry:
    return Registry({"sensor/temperature": TEMPERATURE, "sensor/pressure": PRESSURE, "payment": Payment(), "audit": Audit()})


def handle(events: DataFrame, registry: Registry) -> DataFrame:
    """events with handler, reason, alert_level, message and outcome (DROP, FAIL, ALERT or SUCCESS).

    The first failure is the reason: validation before rules; what fails there is dropped and not handled. An
    outcome of DROP or FAIL without a reason is the handler's own. The handler is looked for once, and what it
    says of an event is one value.
    """
    said = lambda h: F.struct(
        F.lit(h.name).alias("handler"), F.coalesce(h.validate(), h.rules()).alias("reason"), h.failure().alias("failure"), h.level().alias("level"),
        h.message().alias("message")
    )
    x = with_body_numbers(events).withColumn("__number", registry.number())
    x = x.withColumn("__said", registry.choose(said, F.col("__number"))).drop("__number", FIRST_BYTE, AMOUNT)
    passed = F.col("__said.reason").isNull()
    level = F.when(passed & F.col("__said.failure").isNull(), F.col("__said.level"))
    outcome = F.when(~passed, "DROP").when(
        F.col("__said.failure").isNotNull(), F.col("__said.failure")
    ).when(F.col("__said.level").isNotNull(), "ALERT").otherwise("SUCCESS")
    return x.withColumns({
        "handler": F.col("__said.handler"), "reason": F.col("__said.reason"), "alert_level": level,
        "message": F.when(passed, F.col("__said.message")), "outcome": outcome
    }).drop("__said")
