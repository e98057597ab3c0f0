"""Column layouts shared by readers and operators."""

QUESTIONS = "id long, title string, body string, code string, links string, tags string"
QUESTIONS_CSV = "id long, title string, body string, tags string"
TEST_CSV = "id long, title string, body string"
SCORES = "id long, tag string, score double"
PREDICTIONS = "id long, tags string"
