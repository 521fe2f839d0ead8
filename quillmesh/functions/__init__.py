"""Part of the quillmesh engine."""
