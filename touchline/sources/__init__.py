"""Reading and writing tracks, passes, templates, homographies and anchors."""
