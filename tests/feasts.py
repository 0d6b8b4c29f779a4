"""A small calendar of feasts with known days."""

COLUMNS = "id bigint, primary_name string, tradition string, calendar_type string, date_rule string, precedence string"
FEASTS = [
    (1, "Holy Name", "anglican", "fixed", "01-01", "holy_day"),
    (2, "Easter Day", "anglican", "movable", "easter+0", "principal_feast"),
    (3, "Ash Wednesday", "anglican", "movable", "easter-46", "holy_day"),
    (4, "Saint Mark", "anglican", "fixed", "04-25", "holy_day"),
    (5, "Annunciation", "anglican", "fixed", "03-25", "holy_day"),
    (6, "Vincent", "anglican", "commemoration", "03-15", "lesser_commemoration"),
    (7, "Patrick", "anglican", "commemoration", "03-17", "lesser_commemoration"),
    (8, "Transfiguration", "anglican", "fixed", "08-06", "holy_day"),
    (9, "All Saints", "anglican", "fixed", "11-01", "principal_feast"),
    (10, "First Advent", "anglican", "movable", "advent_1+0", "principal_feast"),
    (11, "Leap Day", "anglican", "commemoration", "02-29", "lesser_commemoration"),
    (12, "Twin", "anglican", "commemoration", "03-15", "lesser_commemoration"),
    (13, "Pascha", "byzantine", "movable", "easter+0", "principal_feast"),
    (14, "Saint George", "byzantine", "fixed", "04-23", "holy_day"),
    (15, "Weekday", "anglican", "fixed", "05-05", "ferial"),
    (16, "Thanksgiving", "anglican", "movable", "fourth_thursday_of_november", "holy_day"),
]


def feasts(spark):
    return spark.createDataFrame(FEASTS, COLUMNS)
