"""Whole pages: the rows a page shows, its chart catalogue, its report and its export."""
