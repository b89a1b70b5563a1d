"""A listing of three pages with two rows each."""


def demo_page(page: int) -> list[tuple[str, str]]:
    return [(f"http://example.org/{page}/{i}", f'{{"n": {i}}}') for i in range(2)] if page < 3 else []
