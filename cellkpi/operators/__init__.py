"""DataFrame-to-DataFrame steps: filters, measures, roll-ups and series windows."""
