"""A page, and for each constraint kind a case that it meets, one that it breaks, and what is found then."""

PAGE = "Plan one: stop (now). Is 7 of 12.5 fine?\n- **Bold** one two\n* plain\n1. First item. Done.\n2) next\nB. Line has Tea and tea\n| a | b |\n|---|---|\n| 1 | 2 |\nends well"
CASES = [
    ("word_count", {"value": 40}, {"value": 9}, "word_count: 40 found"), ("word_range", {"min": 1, "max": 90}, {"min": 50, "max": 60}, "word_range: 40 found"),
    ("word_limit", {"max": 40}, {"max": 39}, "word_limit: 40 found"), ("first_word", {"word": "Plan"}, {"word": "plan"}, "first_word: Plan"),
    ("last_word", {"word": "well"}, {"word": "done"}, "last_word: well"), ("term_occurrence", {"term": "tea", "count": 2}, {"term": "tea", "count": 1}, "term_occurrence('tea'): 2 found"),
    ("forbidden_terms", {"terms": ["coffee"]}, {"terms": ["TEA", "x9", "plan"]}, "forbidden_terms: 'TEA';forbidden_terms: 'plan'"),
    ("allowed_punctuation", None, {}, "allowed_punctuation: not met"), ("forbidden_chars", {"chars": ["#"]}, {"chars": ["#", "(", "|"]}, "forbidden_chars: '(';forbidden_chars: '|'"),
    ("required_terms", {"terms": ["TEA"]}, {"terms": ["tea", "milk"]}, "required_terms: 'milk'"), ("first_prefix", {"prefix": "Plan one"}, {"prefix": "plan"}, "first_prefix: not met"),
    ("parenthetical_count", None, {"value": 1}, "parenthetical_count: not met"), ("bullet_count", {"value": 2}, {"value": 3}, "bullet_count: 2 found"),
    ("numbered_list_count", {"value": 2}, {"value": 1}, "numbered_list_count: 2 found"), ("item_prefix", {"index": 1, "prefix": "First"}, {"index": 2, "prefix": "next"}, "item_prefix: not met"),
    ("item_contains", {"index": 1, "term": "item"}, {"index": 1, "term": "Item"}, "item_contains: not met"), ("item_excludes_chars", {"index": 1, "chars": ["!"]}, {"index": 1, "chars": ["."]}, "item_excludes_chars: not met"),
    ("item_sentence_count", {"index": 1, "value": 2}, {"index": 1, "value": 1}, "item_sentence_count: not met"), ("sentence_count", {"value": 7}, {"value": 2}, "sentence_count: 7 found"),
    ("sentence_contains", {"index": 1, "terms": ["stop"]}, {"index": 1, "terms": ["tea"]}, "sentence_contains: not met"), ("sentence_numeric_tokens", {"index": 2, "min": 2, "max": 2}, {"index": 2, "min": 0, "max": 1}, "sentence_numeric_tokens: not met"),
    ("sentence_is_question", {"index": 2}, {"index": 1}, "sentence_is_question: not met"), ("markdown_table_shape", {"columns": ["a", "b"], "data_rows": 1}, {"columns": ["a"], "data_rows": 1}, "markdown_table_shape: not met"),
    ("trailing_literal", {"literal": "well"}, {"literal": "x"}, "trailing_literal: not met"), ("line_count", {"value": 10}, {"value": 9}, "line_count: 10 found"),
    ("line_prefix_sequence", {"prefixes": ["Plan", "-"]}, {"prefixes": ["Plan", "*", "x"]}, "line_prefix_sequence: line 2;line_prefix_sequence: line 3"),
    ("line_word_limit", {"max_words": 9}, {"max_words": 5}, "line_word_limit: number 1;line_word_limit: number 6"), ("line_contains", {"lines": ["A"], "term": "stop"}, {"lines": ["A", "B"], "term": "stop"}, "line_contains: 'B'"),
    ("bullet_prefix", {"index": 2, "prefix": "plain"}, {"index": 1, "prefix": "plain"}, "bullet_prefix: not met"), ("bullet_word_limit", {"max_words": 3}, {"max_words": 1}, "bullet_word_limit: number 1"),
    ("ends_with", {"suffix": "well"}, {"suffix": "x"}, "ends_with: not met"), ("required_prefix", {"prefix": "Plan"}, {"prefix": "x"}, "required_prefix: not met"),
]
