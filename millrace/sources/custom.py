"""A source of its own through the Python DataSource API: calendar days, read in as many partitions as there are years."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from millrace.catalog import query
from millrace.session import table


class Year(InputPartition):
    def __init__(self, year: int):
        self.year = year


class CalendarReader(DataSourceReader):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last

    def partitions(self) -> list[Year]:
        return [Year(y) for y in range(self.first, self.last + 1)]

    def read(self, partition: Year) -> Iterator[tuple]:
        day = date(partition.year, 1, 1)
        while day.year == partition.year:
            yield (day.isoformat(), day.year, day.timetuple().tm_yday)
            day += timedelta(days=1)


class CalendarSource(DataSource):
    """Options `first` and `last`: years, both included."""

    @classmethod
    def name(cls) -> str:
        return "millrace_calendar"

    def schema(self) -> str:
        return "day string, year bigint, day_of_year bigint"

    def reader(self, schema) -> CalendarReader:
        return CalendarReader(int(self.options["first"]), int(self.options["last"]))


@query("""select strftime(d, '%Y-%m-%d') as day, cast(dayofyear(d) as bigint) as day_of_year, count(event_id) as n
from (select unnest(generate_series(timestamp '2024-01-01', timestamp '2024-12-31', interval 1 day)) as d) left join events on date_trunc('day', ts) = d group by d""")
def source_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by day, days without any too: the calendar comes from the source, a partition a year."""
    spark.dataSource.register(CalendarSource)
    days = spark.read.format("millrace_calendar").option("first", "2024").option("last", "2024").load()
    counts = table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    return days.join(counts, "day", "left").select("day", "day_of_year", F.coalesce("n", F.lit(0)).alias("n"))
