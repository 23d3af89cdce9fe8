"""Short forms shared by the tests."""

import datetime as dt


def day(text):
    return None if text is None else dt.date.fromisoformat(text)


def rows_of(frame, *columns):
    return sorted(
        (tuple(r) for r in frame.select(*(columns or frame.columns)).collect()), key=repr
    )
