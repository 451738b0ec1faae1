"""Where the tests read their tables. A module of its own: ``conftest`` names several files."""

SF_SMALL = "/root/testdata/sf0.001"
