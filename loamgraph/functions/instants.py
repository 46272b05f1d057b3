"""ISO-8601 strings with their own offset, as instants."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A text names an instant only if it ends in an offset; a local time has none.
_OFFSET = r"(Z|z|[+-]\d{2}(:?\d{2})?)$"


def instant(text: Column | str) -> Column:
    """The text as a timestamp; null if it cannot be read or carries no offset."""
    c = F.col(text) if isinstance(text, str) else text
    stripped = F.trim(c.cast("string"))
    return F.when(stripped.rlike(_OFFSET), F.try_to_timestamp(stripped))


def month_of(ts: Column) -> Column:
    """`yyyy-MM` in UTC whatever the session's zone, by calendar arithmetic on whole seconds."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_seconds(ts) / 86400).cast("int"))
    return F.date_format(day, "yyyy-MM")
