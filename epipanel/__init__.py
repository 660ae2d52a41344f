"""Place-level surveillance series and Monte-Carlo draw tables on Spark."""
