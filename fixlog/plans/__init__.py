"""From program text to checked, stratified rules."""
