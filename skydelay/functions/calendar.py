"""H5: US federal holidays on their observed dates, as a column expression.

The rules are evaluated for the date's own year (and for New Year's Day also the next year's, observed on 31 December
when 1 January is a Saturday), so any year a date can have is covered and nothing is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The federal holiday rules (month, day-or-rule, first year in force).
#   New Year's Day 1 Jan observed; Martin Luther King Jr. Day 3rd Monday of January from 1986;
#   Washington's Birthday 3rd Monday of February; Memorial Day last Monday of May;
#   Juneteenth 19 Jun observed, from 2021; Independence Day 4 Jul observed; Labor Day 1st Monday of September;
#   Columbus Day 2nd Monday of October; Veterans Day 11 Nov observed; Thanksgiving 4th Thursday of November;
#   Christmas Day 25 Dec observed. Observed: Saturday -> Friday before, Sunday -> Monday after.


def is_holiday(date: Column | str) -> Column:
    """1 on an observed federal holiday, else 0 (null date -> 0). Whole numbers only: a fixed holiday is observed on its own
    date from Monday to Friday, on the Friday before its Saturday and on the Monday after its Sunday."""
    d = F.col(date) if isinstance(date, str) else date
    y, weekday = F.year(d), F.dayofweek(d)  # Sunday=1, Saturday=7

    md = F.month(d) * 100 + F.dayofmonth(d)
    observed = ((weekday.between(2, 6) & (md.isin(101, 704, 1111, 1225) | ((md == 619) & (y >= 2021))))
                | ((weekday == 6) & (md.isin(1231, 703, 1110, 1224) | ((md == 618) & (y >= 2021))))  # the day before
                | ((weekday == 2) & (md.isin(102, 705, 1112, 1226) | ((md == 620) & (y >= 2021)))))  # the day after
    nth = lambda month, first: md.between(month * 100 + first, month * 100 + first + 6)
    monday = (weekday == 2) & ((nth(1, 15) & (y >= 1986)) | nth(2, 15) | nth(5, 25) | nth(9, 1) | nth(10, 8))
    return F.coalesce(observed | monday | ((weekday == 5) & nth(11, 22)), F.lit(False)).cast("int")


def with_is_holiday(df: DataFrame, date_col: str, out: str = "IS_HOLIDAY") -> DataFrame:
    return df.withColumn(out, is_holiday(date_col))
