"""Policy as data: rules, bands and vocabularies that become small dimension tables."""
