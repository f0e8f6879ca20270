"""DataFrame operators: intake (O7-O10, O16-O18), lifecycle (O11-O14, O19-O22),
TEI structuring (O23-O34) and engines (O15, O39)."""
