"""Hand-written inputs (FIXTURES.md F1, F2, F9)."""

STAR = '<span class="star fill">1</span>'
EMPTY_STAR = '<span class="star">1</span>'


def rating_row(header, value=None, stars=None):
    if stars is not None:
        cell = '<td class="review-rating-stars stars">' + STAR * stars[0] + EMPTY_STAR * stars[1] + "</td>"
    else:
        cell = f'<td class="review-value">{value}</td>'
    return f'<tr><td class="review-rating-header {header.lower()}">{header}</td>{cell}</tr>'


def article(rating, text, rows, with_box=True):
    rating_html = f'<span itemprop="ratingValue">{rating}</span>' if rating is not None else ""
    table = '<table class="review-ratings">' + "".join(rows) + "</table>"
    box = (f'<div class="tc_mobile"><div class="text_content" itemprop="reviewBody">{text}</div>{table}</div>'
           if with_box else f"<div>{text}</div>")
    return f'<article itemprop="review">{rating_html}<h2>t</h2>{box}</article>'


FULL_ROWS = [
    rating_row("Aircraft", "A320"), rating_row("Type Of Traveller", "Solo Leisure"),
    rating_row("Seat Type", "Economy Class"), rating_row("Route", "A to B"),
    rating_row("Date Flown", "July 2024"), rating_row("Seat Comfort", stars=(3, 2)),
    rating_row("Cabin Staff Service", stars=(0, 5)), rating_row("Recommended", "yes"),
    rating_row("Unknown Header", "zzz"),
]

PAGE_TWO = ("<html><body>" + article(8, "✅ Trip Verified | Good flight", FULL_ROWS)
            + article(None, "Good", [rating_row("Route", "X"), rating_row("Route", "Y"),
                                     '<tr><td class="review-rating-header">Wifi &amp; Connectivity</td>'
                                     '<td class="review-rating-stars"></td></tr>']) + "</body></html>")
PAGE_BROKEN = ("<html><body>" + article(5, "A | B | C", FULL_ROWS) + article(3, "x", FULL_ROWS, with_box=False)
               + article(4, "y", ['<tr><td class="other">no header</td></tr>']) + "</body></html>")
PAGE_EMPTY = "<html><body><p>no reviews here</p></body></html>"

RAW_COLUMNS = [
    "airline", "overall_rating", "verification", "review_text", "Aircraft", "Type Of Traveller", "Seat Type",
    "Route", "Date Flown", "Seat Comfort", "Cabin Staff Service", "Food & Beverages", "Inflight Entertainment",
    "Ground Service", "Wifi & Connectivity", "Value For Money", "Recommended",
]


def raw_row(airline, overall, verification, text, route="A", date="July 2024", seat="3", rec="yes", cat="x"):
    return [airline, overall, verification, text, cat, cat, cat, route, date, seat, seat, seat, seat, seat, seat,
            seat, rec]


F2_FILE_A = [  # entity "ANA"
    raw_row("ANA", "8", "✅ Trip Verified", "  Great, \"quoted\"\nsecond line "),
    raw_row("ANA", " 6 ", "Not Verified", "ok", route="A"),
    raw_row("ANA", "8.5", "Verified by X", "fine", route="", date="Jul 2024", rec="Yes", cat="NA"),
    raw_row("ANA", "n/a", "", "  ", route="B", date="july 2024", rec="no", seat=""),
    raw_row("ANA", "10", "", "None", route="C"),  # text "None" -> missing -> dropped
]
F2_FILE_B = [  # entity "Air Canada": ratings all missing
    raw_row("Air Canada", "na", "", "meh", seat=""),
    raw_row("Air Canada", "", "", "bad", seat=""),
]
