"""Small inputs of our own: a year of letters to a fictitious ombudsman."""

from datetime import date, timedelta

COLUMNS = (
    "complaint_id long, date_received string, product string, issue string, sub_issue string, "
    "consumer_complaint_narrative string, channel string, urgent boolean"
)
#: Subject, first day, one letter every so many days, layout of the date, sentence.
SUBJECTS = [
    ("Water meter", 0, 5, "%Y-%m-%d", "The meter ran backwards all {season} and nobody from the {office} came to read it"),
    ("Ferry ticket", 3, 7, "%m/%d/%Y", "We missed the ferry because the {office} had printed a {season} timetable on the ticket"),
    ("Heat pump grant", 200, 4, "%Y/%m/%d", "My grant for a heat pump was turned down this {season} although the {office} had promised it"),
]
OFFICES = ("harbour office", "town hall", "service desk", "inspector")
SEASONS = ("winter", "spring", "summer", "autumn")
FIRST_DAY = date(2018, 3, 1)
SPAN = 364
BLANK = (None, "", " \t", "Call me")


def letters():
    """All letters in order of subject and day; the third subject begins after half the span.

    Ids count up from 1 with a gap after each subject. No letter has fewer than 14 words.
    """
    rows, number = [], 0
    for subject, (product, start, every, layout, sentence) in enumerate(SUBJECTS):
        for n, offset in enumerate(range(start, SPAN, every)):
            number += 1
            day = FIRST_DAY + timedelta(days=offset)
            told = sentence.format(season=SEASONS[(day.month - 1) // 3], office=OFFICES[n % len(OFFICES)])
            issue = None if n % 9 == 4 else f"about {product.split()[0].lower()}"
            rows.append((number, day.strftime(layout), product, issue, f"part {n % 3}", f"{told}.", ("post", "mail")[n % 2], n % 6 == 0))
        number += 1_000 * (subject + 1)
    return rows


def blank_letters():
    """Letters without a usable text; one for each kind of blank and each month's first day."""
    return [
        (-i - 1, FIRST_DAY.replace(month=3 + i).isoformat(), "Other", None, None, BLANK[i % len(BLANK)], "post", False)
        for i in range(9)
    ]


def file_rows():
    """Rows of a delivered file with headers of its own; texts hold quotes and line breaks."""
    header = ["ComplaintID", "date RECEIVED", "Product ", "Issue", "consumer complaint narrative", "Remarks"]
    rows = []
    for number, day, product, issue, _, told, channel, _ in letters()[::3]:
        rows.append([str(number), day, product, issue or "", f'He wrote: "{told}"\nSigned, no. {number}', channel])
    for number, day, product, _, _, told, channel, _ in blank_letters():
        rows.append([str(number), day, product, "", told or "", channel])
    return header, rows
